"""The kernels in the JVM against those of factors.py and codec.py, and that queries on documents stay in their rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import SPECIAL, repetitive

from refrain.functions import codec
from refrain.functions import factors as K
from refrain.functions.suffixes import Suffixes, batch
from refrain.operators import factorize as Z
from refrain.plans import core


def _cases() -> list[bytes]:
    rng = random.Random(5)
    lines = [b" ".join(rng.choice([b"one", b"two", b"three", b"vier", b"cinq"]) for _ in range(rng.randint(1, 30))) for _ in range(9)]
    return [*SPECIAL, *(repetitive(rng) for _ in range(60)), b"\n".join(rng.choice(lines) for _ in range(120)), b"x" * 5000, b"ab" * 3000 + b"c" + b"ab" * 3000]


@pytest.fixture(scope="module")
def cases(spark):
    data = _cases()
    return data, Suffixes(*batch(data)), spark.createDataFrame(list(enumerate(data)), "text_id long, data binary").repartition(3).cache()


def _columns(df, *names):
    return [tuple(r) for r in df.select(*names).orderBy("text_id", names[1]).collect()]


def _factors(f):
    return list(zip(*(f[c].tolist() for c in ("text", "phrase_no", "pos", "src", "len", "literal"))))


@pytest.mark.parametrize("sections, least", [(1, 1), (1, 4), (3, 1), (7, 3)])
def test_exact(cases, sections, least):
    _, index, df = cases
    assert _columns(Z.factorize(df, sections, least), "text_id", "phrase_no", "pos", "src", "len", "literal") == _factors(K.exact(index, sections, least))


@pytest.mark.parametrize("mode", K.PHRASES)
@pytest.mark.parametrize("tau", [1, 3, 8])
def test_phrases_and_approximate_factors(cases, mode, tau):
    data, index, df = cases
    want = [(k, *(int(x - index.offs[k]) for x in p)) for k in range(len(data)) for p in K.phrases(index, k, tau, mode)]
    got = [(r[0], *p) for r in Z.packed_phrases(df, tau, mode).orderBy("text_id").collect() for p in r[1]]
    assert got == want
    for fill in ("greedy", "greedy_naive"):
        f = K.approximate(index, tau, mode, fill)
        assert _columns(Z.approximate(df, tau, mode, fill), "text_id", "phrase_no", "pos", "src", "len", "literal") == _factors(f)
        rows = {r.text_id: tuple(r)[1:] for r in Z.counts(df, tau, mode, fill).collect()}
        for k, t in enumerate(data):
            own = f["text"] == k
            assert rows[k] == (len(t), own.sum(), (f["len"][own] == 0).sum(), codec.stream_bits(f["len"][own], (f["pos"] - f["src"])[own]))


def test_selection_statistics_and_gapped_files(spark, cases):
    data, index, df = cases
    rng = random.Random(2)
    found = [(k, b, b + rng.randint(1, 30), rng.randrange(99)) for k in range(20) for b in (rng.randrange(60) for _ in range(25))]
    want = [(k, *p) for k in range(20) for p in K.select([p[1:] for p in sorted(found) if p[0] == k])]
    assert _columns(Z.select_phrases(spark.createDataFrame(found, "text_id long, beg long, end long, src long")), "text_id", "beg", "end", "src") == want
    assert sorted(map(str, Z.text_statistics(df, 4).collect())) == sorted(map(str, Z.phrase_statistics(Z.phrases(df, 4), df).collect()))
    steps = [(k, i, kind, -1 if kind == "gap" else a, a if kind == "gap" else b) for k in range(len(data)) for i, (kind, a, b) in enumerate(K.gapped(index, k, 4))]
    assert _columns(Z.gapped(df, 4), "text_id", "step", "kind", "src", "len") == steps
    for least in (1, 8, 64):
        files = Z.encode_gapped(df, 4, min_copy=least)
        assert [bytes(r[1]) for r in files.orderBy("text_id").collect()] == [codec.write_gapped(t, K.gapped(index, k, 4), least) for k, t in enumerate(data)]
        assert [bytes(r[1]) for r in Z.decode_gapped(files).orderBy("text_id").collect()] == data


def test_packed_factors_and_bad_ones(spark, cases):
    data, _, df = cases
    for tau in (None, 4):
        assert [bytes(r[1]) for r in Z.unpacked(Z.packed(df, tau)).orderBy("text_id").collect()] == data
    bad = spark.createDataFrame([(1, 0, 0, -1, 0, 97), (1, 1, 1, 1, 3, -1)], "text_id long, phrase_no long, pos long, src long, len long, literal long")
    with pytest.raises(Exception, match="copies from 1"):
        Z.decode(bad).collect()


def test_code_lengths_of_skewed_symbols(spark):
    """Texts whose Huffman codes would be longer than is allowed."""
    rng = np.random.default_rng(3)
    data = [b"".join(bytes([k % 256, k // 256]) * int(1.5**k) for k in range(n)) for n in (8, 16, 22)] + [rng.integers(0, 256, 60_000).astype(np.uint8).tobytes()]
    df = spark.createDataFrame(list(enumerate(data)), "text_id long, data binary")
    for r in Z.counts(df).collect():
        f = K.exact(Suffixes(*batch([data[r.text_id]])))
        assert (r.factors, r.encoded_bits) == (len(f["pos"]), codec.stream_bits(f["len"], f["pos"] - f["src"]))


@pytest.mark.parametrize("name", ["decode_roundtrip", "approximate_roundtrip", "gapped_roundtrip", "select_phrases", "phrase_stats", "documents_factor_counts", "factorize_gapped", "factorize_approx_naive_fill", *(f"{q}_{m}" for q in ("phrases", "factorize_approx") for m in K.PHRASES)])
def test_no_row_of_a_factor_is_moved(spark, sf, monkeypatch, name):
    """Over a table that needs no dealing out, nothing is shuffled, sorted or sent to Python."""
    monkeypatch.setattr(core, "spread", lambda t: t)
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Sort", "Join", "Arrow", "Python") if x in plan]


def test_ratio_and_sessions(spark, sf):
    other = spark.newSession()
    assert sorted(map(str, core.QUERIES["approx_ratio"](other, sf).collect())) == sorted(map(str, core.QUERIES["approx_ratio"](spark, sf).collect()))
    assert Z.factorize(other.range(3).select(F.col("id").alias("text_id"), F.encode(F.lit("aaaa"), "UTF-8").alias("data"))).count() == 6
