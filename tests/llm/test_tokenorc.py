from pathlib import Path

import pyarrow.orc as orc
import pytest
from refrain.llm import tokenorc as T


def test_round_trip_and_edge_cases(spark):
    rows = [(2, "Hello <|endoftext|>", 1), (1, "", 2), (None, "x", 3), (4, None, 4), (5, "many words " * 30_000, 5), (5, "many words " * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = T.round_trip(df).collect()
    code = T.encoding(T.RANKS)
    assert sorted((r.doc_id or 0, None if r.tokens is None else code.decode(r.tokens)) for r in got if r.doc_id != 4) == sorted((r[0] or 0, r[1]) for r in rows if r[0] != 4)
    assert [(r.n_tokens, r.tokens) for r in got if r.doc_id == 4] == [(None, None)]
    assert all(r.n_tokens == len(r.tokens) for r in got if r.tokens is not None)
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stripes_indexes_and_pruning(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet")
    path = str(tmp_path / "t.orc")
    T.write(T.tokenize(docs.coalesce(1)), path, stripe_bytes=1_000_000)
    file = next(Path(path).glob("*.orc"))
    assert orc.ORCFile(file).nstripes > 1
    assert b"doc_id" in file.read_bytes()[-4000:]
    wanted = docs.orderBy("doc_id").limit(3).collect()
    rows = T.read(spark, path, [r.doc_id for r in wanted])
    assert "PushedFilters: [In(doc_id" in rows._jdf.queryExecution().executedPlan().toString()
    code = T.encoding(T.RANKS)
    assert {r.doc_id: code.decode(r.tokens) for r in rows.collect()} == {r.doc_id: r.text for r in wanted}
    assert scanned(T.read(spark, path, [wanted[0].doc_id])) <= 2 * T.INDEX_ROWS < docs.count()
    assert scanned(T.read(spark, path, [10**15])) == 0
    with pytest.raises(ValueError):
        T.write(T.tokenize(docs), path, index_rows=50)


def scanned(rows) -> int:
    """Rows that the scan gave out, before the filter."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_ranges_do_not_overlap_and_splits_read_stripes_in_parallel(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    path = str(tmp_path / "t.orc")
    T.write(T.tokenize(docs), path, ranges=4)
    seen = sorted((min(ids), max(ids)) for f in Path(path).glob("*.orc") if (ids := orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()))
    assert len(seen) == 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    T.write(T.tokenize(docs.coalesce(1)), str(tmp_path / "one.orc"), stripe_bytes=100_000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = T.read(spark, str(tmp_path / "one.orc"))
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == docs.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
