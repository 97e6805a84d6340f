"""Operators on tables: registered queries against their SQL, edge cases, range search by brute force, files and the CLI."""

import random
import shutil

import __spark_entry__
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from refrain import cli
from refrain.functions.boxes import Tree
from refrain.operators import factorize as Z
from refrain.operators import positions as P
from refrain.operators import ranges as R
from refrain.operators import sampleindex as X
from refrain.operators import strings as S
from refrain.plans import core
from refrain.sources import texts as T
from texts import SPECIAL, common, greedy, repetitive

TEXTS = "text_id long, data binary"


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in ("benchmark", "documents", "orders", "events"):
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def _sorted(rows):
    rounded = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(rounded, key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    out = core.QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    want = db.sql(f"select {', '.join(columns)} from ({core.ORACLE_SQL[name]}) q").fetchall()
    assert got and _sorted(got) == _sorted(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 40


def _texts(spark, rows):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(rows)], TEXTS)


def test_factors_of_special_texts(spark):
    rng = random.Random(1)
    rows = SPECIAL + [repetitive(rng) for _ in range(40)] + [b"long " * 30_000]
    df = _texts(spark, rows)
    found: dict[int, list] = {i: [] for i in range(len(rows))}
    for r in Z.factorize(df).orderBy("text_id", "phrase_no").collect():
        found[r.text_id].append((r.pos, r.src, r.len))
    for i, t in enumerate(rows[:-1]):
        assert found[i] == greedy(t)
    back = {r.text_id: bytes(r.data) for r in Z.decode(Z.factorize(df), df).collect()}
    assert back == dict(enumerate(rows))
    counts = {r.text_id: (r.bytes, r.factors) for r in Z.counts(df).collect()}
    assert counts == {i: (len(t), len(found[i])) for i, t in enumerate(rows)}
    for many in (Z.decode_stream(Z.encode_stream(df)), Z.decode_gapped(Z.encode_gapped(df, 4, min_copy=4))):
        assert {r.text_id: bytes(r.data) for r in many.collect()} == dict(enumerate(rows))
    assert Z.factorize(df.limit(0)).count() == 0 and Z.corpus(Z.statistics(Z.factorize(df.limit(0)))).first().bytes_per_factor is None
    with pytest.raises(ValueError):
        Z.approximate(df, mode="none")


def test_phrase_statistics_by_counting(spark):
    rng = random.Random(2)
    rows = [repetitive(rng) for _ in range(30)] + SPECIAL
    df = _texts(spark, rows)
    phrases: dict[int, list] = {i: [] for i in range(len(rows))}
    for r in Z.phrases(df, 4).orderBy("text_id", "beg").collect():
        phrases[r.text_id].append((r.beg, r.end))
    for r in Z.phrase_statistics(Z.phrases(df, 4), df).collect():
        ps, n = phrases[r.text_id], len(rows[r.text_id])
        edges = [(0, 0), *ps, (n, n)]
        assert (r.bytes, r.phrases, r.covered, r.gaps) == (n, len(ps), sum(b - a for a, b in ps), sum(a[1] < b[0] for a, b in zip(edges, edges[1:])))
    steps = Z.gapped(df, 4).groupBy("text_id").agg(F.sum("len").alias("n")).collect()
    assert {r.text_id: r.n for r in steps} == {i: len(t) for i, t in enumerate(rows) if t}
    chosen = Z.select_phrases(Z.phrases(df, 4, "lpf_naive")).groupBy("text_id").agg(F.sum(F.col("end") - F.col("beg")).alias("n"))
    every = Z.phrases(df, 4, "lpf_naive").select("text_id", F.explode(F.sequence("beg", F.col("end") - 1)).alias("p")).distinct().groupBy("text_id").count()
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in every.collect()}


def test_extensions_at_the_ends_and_outside(spark):
    data = bytearray(b"abcabcab")
    pairs = [(i, j) for i in range(-1, 10) for j in range(-1, 10)]
    df = spark.createDataFrame([(data, i, j) for i, j in pairs], "data binary, i long, j long")
    d, i, j = F.col("data"), F.col("i"), F.col("j")
    for r in df.select("i", "j", S.lce_right(d, i, j).alias("right"), S.lce_left(d, i, j).alias("left"), S.lce_left(d, i, j, F.lit(2)).alias("two"), S.lce_right(d, i, j, most=F.lit(1)).alias("one")).collect():
        inside = 0 <= r.i < 8 and 0 <= r.j < 8
        right = common(bytes(data[r.i :]), bytes(data[r.j :])) if inside else 0
        left = common(bytes(data[: r.i + 1][::-1]), bytes(data[: r.j + 1][::-1])) if inside else 0
        assert (r.right, r.left, r.two, r.one) == (right, left, min(2, left), min(1, right)), (r.i, r.j)


@pytest.mark.parametrize("strategy, side", [("grid", 7), ("grid", 64), ("stripe", 5), ("quantile", 6)])
def test_range_search_by_brute_force(spark, strategy, side):
    rng = np.random.default_rng(3)
    n = 400
    points = [(int(x), int(y), int(w)) for x, y, w in zip(rng.integers(-50, 50, n), rng.integers(-50, 50, n), rng.permutation(n))] + [(0, 0, 5), (0, 0, 5)]
    boxes = [(q, *(int(v) for v in (a, a + rng.integers(-2, 40), b, b + rng.integers(-2, 40), rng.integers(0, n)))) for q, (a, b) in enumerate(rng.integers(-60, 60, (200, 2)))]
    got = R.lighter_points(spark.createDataFrame(points, "x long, y long, weight long"), spark.createDataFrame(boxes, "query_id long, x1 long, x2 long, y1 long, y2 long, weight long"), strategy, side).collect()
    assert len(got) == len(boxes)
    some = 0
    for r in got:
        _, x1, x2, y1, y2, w = boxes[r.query_id]
        inside = sorted((p[2], p[0], p[1]) for p in points if x1 <= p[0] <= x2 and y1 <= p[1] <= y2 and p[2] < w)
        assert (r.found, r.hits) == (bool(inside), len(inside))
        assert not inside or (r.weight, r.x, r.y) == inside[0]
        some += bool(inside)
    assert some > 50


def test_range_search_by_key_and_over_time(spark):
    rng = np.random.default_rng(4)
    points = [(*(int(v) for v in rng.integers(0, 30, 2)), w, int(rng.integers(3))) for w in range(300)]
    boxes = [(q, int(a), int(a) + 9, int(b), int(b) + 9, 200, int(rng.integers(3))) for q, (a, b) in enumerate(rng.integers(0, 30, (100, 2)))]
    got = R.lighter_points(spark.createDataFrame(points, "x long, y long, weight long, c int"), spark.createDataFrame(boxes, "query_id long, x1 long, x2 long, y1 long, y2 long, weight long, c int"), "grid", 4, ("c",)).collect()
    for r in got:
        _, x1, x2, y1, y2, w, c = boxes[r.query_id]
        assert r.hits == sum(x1 <= p[0] <= x2 and y1 <= p[1] <= y2 and p[2] < w and p[3] == c for p in points)
    log = [(i, bool(i % 3), int(a), int(a) + 6, int(b), int(b) + 6) for i, (a, b) in enumerate(rng.integers(0, 40, (500, 2)))]
    for r in R.points_so_far(spark.createDataFrame(log, "op_id long, is_insert boolean, x1 long, x2 long, y1 long, y2 long"), side=8).collect():
        _, _, x1, x2, y1, y2 = log[r.op_id]
        before = [o[0] for o in log[: r.op_id] if o[1] and x1 <= o[2] <= x2 and y1 <= o[4] <= y2]
        assert (r.found, r.hits, r.first_op) == (bool(before), len(before), before[0] if before else None)


def test_no_strategy_compares_all_pairs(spark, sf):
    for name in ("lighter_point_grid", "lighter_point_stripe", "lighter_point_quantile", "decomposed_range", "point_in_range"):
        plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n, span", [(0, 5), (1, 5), (7, 2), (600, 6), (3000, 1000)])
def test_tree_by_brute_force(n, span):
    rng = np.random.default_rng(n)
    points = rng.integers(-span, span, (n, 3))
    if n == 7:
        points[:2] = np.iinfo(np.int64).max
    least = rng.integers(-span - 2, span + 2, (700, 3))
    most = least + rng.integers(-1, 2 * span, least.shape)
    most[:3] = np.iinfo(np.int64).max
    tree = Tree(points)
    for b, t, count, light in zip(least, most, *tree.answer(least, most)):
        inside = points[((points >= b) & (points <= t)).all(1)]
        assert count == len(inside) and (light == n) == (not len(inside))
        assert not len(inside) or tuple(tree.points[light][[2, 0, 1]]) == min(map(tuple, inside[:, [2, 0, 1]]))


@pytest.mark.parametrize("strategy", ["stripe", "quantile"])
@pytest.mark.parametrize("kind", ["long", "int", "double"])
def test_stripes_of_odd_points_and_boxes(spark, strategy, kind):
    """Nulls, equal boxes' ids, boxes without points, extremes, keys."""
    some = 1 if kind != "double" else 1.0
    points = [(x * some, y * some, w * some, c) for x, y, w, c in [(1, 1, 5, 0), (1, 1, 3, 0), (1, 2, 3, 0), (2, 9, 0, 1), (-4, 0, 1, 1), (1, 1, -9, None)]] + [(None, some, some, 0), (some, None, some, 0), (some, some, None, 0)]
    boxes = [(q, *(v * some for v in r[:5]), r[5]) for q, r in [(1, (0, 9, 0, 9, 4, 0)), (1, (2, 2, 0, 9, 4, 1)), (2, (3, 2, 0, 9, 9, 0)), (3, (-9, 9, -9, 9, 9, 1)), (4, (-9, 9, -9, 9, -100, 0)), (5, (0, 9, 0, 9, 9, None))]] + [(6, some, some, some, some, None, 0)]
    names = "c int, query_id long" if kind == "long" else "c int, query_id int"
    p = spark.createDataFrame(points, f"x {kind}, y {kind}, weight {kind}, c int")
    b = spark.createDataFrame(boxes, f"{names.split(', ')[1]}, x1 {kind}, x2 {kind}, y1 {kind}, y2 {kind}, weight {kind}, c int")
    got = {(r.query_id, r.found, r.hits, r.x, r.y, r.weight) for r in R.lighter_points(p, b, strategy, 2, ("c",)).collect()}
    assert got == {(1, True, 3, 2, 9, 0), (2, False, 0, None, None, None), (3, True, 2, 2, 9, 0), (4, False, 0, None, None, None), (5, False, 0, None, None, None), (6, False, 0, None, None, None)}
    assert R.lighter_points(p, b, strategy, 2).schema["x"].dataType == p.schema["x"].dataType
    assert R.lighter_points(p, b.limit(0), strategy).count() == 0 and R.lighter_points(p.limit(0), b, strategy).where("found").count() == 0


@pytest.mark.parametrize("name", ["lighter_point_stripe", "lighter_point_quantile"])
def test_no_stripe_compares_all_its_pairs(spark, sf, name):
    """Boxes and points of a stripe aren't joined: their pairs grow as the square of the tables."""
    plan = core.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "cx" not in "".join(x for x in plan.split("\n") if "Join" in x)


def test_located_patterns_by_brute_force(spark):
    rng = random.Random(5)
    rows = [repetitive(rng, 200) for _ in range(12)]
    df = _texts(spark, rows)
    samples = [(i, k, p) for i, t in enumerate(rows) for k, p in enumerate(sorted(rng.sample(range(len(t)), len(t) // 3)))]
    index = X.build(df, spark.createDataFrame(samples, "text_id long, idx long, pos long")).cache()
    asked = [(q, i, rng.randrange(len(rows[i])), rng.randint(1, 6)) for q, i in enumerate(rng.choices([i for i, t in enumerate(rows) if t], k=150))]
    queries = spark.createDataFrame(asked, "query_id long, text_id long, pos long, len long")
    for direction in ("left", "right"):
        want = set()
        for q, i, p, n in asked:
            t = rows[i]
            cut = (lambda a: t[a : a + n]) if direction == "right" else (lambda a: t[a - n + 1 : a + 1] if a - n + 1 >= 0 else b"")  # noqa: B023
            want |= {(q, k, a) for j, k, a in samples if j == i and len(cut(a)) == n == len(cut(p)) and cut(a) == cut(p)}
        assert {tuple(r)[:3] for r in X.locate(df, index, queries, direction).collect()} == want
        rank = "sa_rank" if direction == "right" else "pa_rank"
        by = {(r.text_id, r.idx): r[rank] for r in index.collect()}
        for r in X.extend(df, index, queries, direction).collect():
            ranks = sorted(by[asked[q][1], k] for q, k, _ in want if q == r.query_id)
            assert (r.found, r.samples) == (bool(ranks), len(ranks))
            assert not ranks or (ranks == list(range(r.first_rank, r.last_rank + 1)))
    index.unpersist()


def test_files_logs_and_factor_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"\x00\xffabcabc")
    read = T.files(spark, f"{tmp_path}/in/*.bin")
    assert [bytes(r.data) for r in read.collect()] == [b"\x00\xffabcabc"]
    factors = Z.factorize(read)
    T.write_factors(factors, f"{tmp_path}/factors")
    again = T.read_factors(spark, f"{tmp_path}/factors")
    assert _sorted(again.collect()) == _sorted(factors.collect())
    T.write_texts(read.select("text_id", "data"), f"{tmp_path}/texts")
    assert spark.read.parquet(f"{tmp_path}/texts").count() == 1
    points, ops = spark.createDataFrame([(1, 2, 3)], "x long, y long, weight long"), spark.createDataFrame([(1, True)], "op_id long, is_insert boolean")
    T.write_range_log(points, ops, f"{tmp_path}/log")
    assert [x.count() for x in T.read_range_log(spark, f"{tmp_path}/log")] == [1, 1]
    T.append_metrics({"z": 3}, f"{tmp_path}/m.jsonl")
    assert (tmp_path / "m.jsonl").read_text() == '{"z": 3}\n'


def test_texts_leave_out_nulls_and_keep_bytes(spark):
    df = spark.createDataFrame([(1, "é"), (2, None), (None, "x")], "k long, data string").withColumn("text_id", F.lit("other"))
    assert sorted((r.text_id or 0, bytes(r.data)) for r in T.texts(df, "k", "data").collect()) == [(0, b"x"), (1, "é".encode())]


def test_small_inputs_are_spread_and_large_ones_left(spark, sf):
    docs = T.texts(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    assert T.spread(docs).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert T.spread(docs).count() == docs.count()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert "Exchange" not in T.spread(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_samples_are_never_further_apart_than_delta(spark):
    rng = random.Random(6)
    rows = [repetitive(rng) for _ in range(20)]
    factors = Z.factorize(_texts(spark, rows))
    deltas = {r.text_id: r.delta for r in P.delta(Z.statistics(factors)).collect()}
    found: dict[int, list[int]] = {}
    for r in P.factor_ends(factors).orderBy("text_id", "idx").collect():
        found.setdefault(r.text_id, []).append(r.pos)
    for i, t in enumerate(rows):
        z = greedy(t)
        if z:
            ends = [p for p, _, _ in z]
            assert found[i][0] == 0 and set(ends) <= set(found[i])
            assert all(0 < b - a <= deltas[i] for a, b in zip(found[i], found[i][1:]))


def test_command_line(tmp_path, capsys):
    rng = random.Random(7)
    for k, t in enumerate([b"", b"a", repetitive(rng, 3000), b"\x00\xff" * 500]):
        file = tmp_path / f"f{k}.txt"
        for mode in ("exact", "lpf_opt", "lpf_lnf_opt"):
            file.write_bytes(t)
            cli.main(["factorize", "--mode", mode, "--tau", "4", str(file)])
            cli.main(["decode", "-o", str(tmp_path / "back"), f"{file}.lz"])
            assert (tmp_path / "back").read_bytes() == t
        for encoder, (ext, _, _) in cli.ENCODERS.items():
            file.write_bytes(t)
            cli.main(["compress", "-q", "-e", encoder, "--tau", "4", str(file)])
            assert not file.exists()
            cli.main(["decompress", "-q", f"{file}.gap{ext}"])
            assert file.read_bytes() == t and not (tmp_path / f"f{k}.txt.gap{ext}").exists()
            cli.main(["compress", "-q", "-k", "-e", encoder, str(file)])
            assert file.exists()
    with pytest.raises(SystemExit):
        cli.main(["decode", str(tmp_path / "none")])


def test_the_rest_works_without_the_subpackage(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "refrain", tmp_path / "refrain", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
