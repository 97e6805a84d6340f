"""op4, op8, op9 and op10 against brute force and on their edge cases; they have no SQL."""

from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from refrain.llm import packing, quality, substring, toxicity

EDGES = [(1, None), (2, ""), (3, " \n "), (None, "some plain words of a text"), (5, "some plain words of a text"), (5, "some plain words of a text")]


def test_repeats_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(40):
        text = [words[k] for k in rng.integers(30, size=rng.integers(0, 60))]
        if i and rng.random() < 0.7:
            other = (rows[rng.integers(len(rows))][1] or "").split()
            a = int(rng.integers(len(other) + 1))
            at = int(rng.integers(len(text) + 1))
            text[at:at] = other[a : a + int(rng.integers(4, 30))]
        rows.append((i, " ".join(text)))
    rows += [(40, None), (None, rows[3][1]), (41, "a b " * 20), (42, "\t".join(rows[5][1].split()))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (5, 8):
        got = [tuple(r) for r in substring.repeated_passages(df, min_words=least).collect()]
        assert len(got) == len(set(got)) > 0
        assert set(got) == brute.repeats(rows, least)
    # in many bundles, with rows that come twice, and in many ranges
    monkeypatch.setattr(substring, "RANGE", 40)
    for parts in (2, 7, 40):
        many = df.unionAll(df.where("doc_id % 3 = 0")).repartition(parts)
        assert {tuple(r) for r in substring.repeated_passages(many, min_words=5).collect()} == brute.repeats(rows, 5)
    assert substring.repeated_passages(df.limit(0)).count() == 0


def test_periodic_texts_are_one_repeat(spark):
    df = spark.createDataFrame([(1, "same " * 2000), (2, "one two three " * 300), (3, "same " * 500)], "doc_id long, text string")
    assert sorted(map(tuple, substring.repeated_passages(df).collect())) == [(1, 1, 1999, 1, 0), (2, 3, 897, 2, 0), (3, 0, 50, 1, 0), (3, 1, 499, 3, 0)]


def test_repeat_under_a_null_id_and_id_zero(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string").unionAll(spark.createDataFrame([(None, text)], "doc_id long, text string"))
    assert [tuple(r) for r in substring.repeated_passages(df).collect()] == [(None, 0, 80, 0, 0)]


def test_packing_places_every_word_once(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(0, 70, 300))] + [(400, None), (401, " \n"), (402, "w " * 64)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=32).collect()
    placed, bins = Counter(), defaultdict(list)
    for r in got:
        placed[r.doc_id] += r.length
        bins[r.bin_id].append((r.bin_offset, r.length))
    assert placed == {i: len(t.split()) for i, t in rows if t and t.split()}
    for parts in bins.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 32
    least = sum(placed.values()) / 32
    assert least <= len(bins) <= 1.1 * least + 1


def test_packing_counts_of_a_column(spark):
    rows = [(1, 20), (2, 12), (3, 40), (4, None), (5, 0), (6, -3)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n int").selectExpr("*", "'x' AS text"), capacity=32, length_col="n").collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == [(1, 0, 20), (2, 0, 12), (3, 0, 32), (3, 1, 8)]
    assert len({r.bin_id for r in got}) == 3


def test_plan_fills_gaps_by_pairs_and_triples():
    counts = np.bincount([90, 6, 4, 80, 9, 8, 3, 70, 30], minlength=101)
    bins = packing.plan(counts, 100)
    assert sorted(tuple(sorted(p)) for p, n in bins for _ in range(n)) == [(3, 8, 9, 80), (4, 6, 90), (30, 70)]


FEW = pytest.mark.xfail(strict=True, reason="with 38 toxic labels to learn from in sf0.01 op4 finds 2 of 13 held-out toxic documents; open")


@pytest.mark.parametrize(
    "table, label, run, flag",
    [("sf0.01", "quality", quality.classify, "kept"), pytest.param("sf0.01", "toxic", toxicity.classify, "toxic", marks=FEW), ("sf0.1", "quality", quality.classify, "kept"), ("sf0.1", "toxic", toxicity.classify, "toxic")],
)
def test_classifiers_on_labels_they_did_not_see(spark, sf, table, label, run, flag):
    where = sf.replace("sf0.001", table)
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = {r.doc_id: r[flag] for r in run(docs, labels.where("doc_id % 3 > 0")).collect()}
    assert len(got) == docs.count()
    held = [(r[label], got[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect()]
    share = [np.mean([g == (y == 1) for y, g in held if y == v]) for v in (0, 1)]
    print(f"{table} {label}: right on held-out labels 0, 1: {share[0]:.3f}, {share[1]:.3f} of {len(held)}")
    assert min(share) >= 0.8


def test_classifiers_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    good = quality.classify(docs, none).collect()
    assert sorted((r.doc_id or 0, r.quality_score, r.kept) for r in good) == [(0, 1, True), (1, 0, False), (2, 0, False), (3, 0, False), (5, 1, True), (5, 1, True)]
    toxic = toxicity.classify(docs, none).collect()
    assert len(toxic) == len(EDGES) and not any(r.toxic for r in toxic)


def test_classifiers_with_other_column_names(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = docs.withColumnsRenamed({"doc_id": "key", "text": "body"}).selectExpr("*", "1 AS doc_id", "'x' AS text")
    odd = labels.unionByName(labels.selectExpr("doc_id + 1000000 AS doc_id", "7 AS quality", "7 AS toxic"))
    for run in (quality.classify, toxicity.classify):
        assert sorted(map(tuple, run(other, odd, id_col="key", text_col="body").collect())) == sorted(map(tuple, run(docs, labels).collect()))
