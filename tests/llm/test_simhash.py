import time
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
from refrain.llm import bytekit as B
from refrain.llm import simhash as S


def test_near_copies_of_middling_texts_by_brute_force(spark, sf):
    """Copies with a share of words replaced, held against word 3-gram Jaccard similarity."""
    rng = np.random.default_rng(5)
    texts = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    long = [t[:300] for t in texts if len(t) >= 80][:60]
    rows = []
    for k, words in enumerate(long):
        rows.append((3 * k, " ".join(words)))
        for j in (1, 2):
            copy = words.copy()
            for at in rng.choice(len(copy), max(1, round(len(copy) * rng.uniform(0.02, 0.06))), replace=False):
                copy[at] = long[rng.integers(len(long))][rng.integers(80)]
            rows.append((3 * k + j, " ".join(copy)))
    pairs = brute.alike(rows, 0.7)
    group = {r.doc_id: r.group_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = sum(group[a] == group[b] for a, b in pairs)
    assert len(pairs) > 100
    assert together >= 0.95 * len(pairs)


def test_documents_of_the_table_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.dropDuplicates(["text"]).collect()]
    pairs = brute.alike(rows, 0.7)
    group = {r.doc_id: r.group_id for r in S.near_duplicates(docs).collect()}
    together = sum(group[a] == group[b] for a, b in pairs)
    print(f"word 3-gram Jaccard >= 0.7: {together} of {len(pairs)} pairs in one group")
    assert together >= 0.95 * len(pairs)


def test_candidates_at_the_radius():
    """Pairs of fingerprints at exactly the radius, searched in all splits of all segments."""
    rng = np.random.default_rng(9)
    n, prefix = 1500, 2
    one = rng.integers(0, 2, (n, 256)).astype(np.uint8)
    two = one.copy()
    for row in two:
        row[rng.choice(256, S.RADIUS, replace=False)] ^= 1
    fps = np.packbits(np.concatenate((one, two)), axis=1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n)), pa.array([f.tobytes() for f in fps], pa.binary())], ["node", "fp"])
    table = pa.Table.from_batches(S._scatter(prefix)([batch]))
    found = set()
    for part in set(table["part"].to_pylist()):
        mine = table.filter(pa.compute.equal(table["part"], part))
        edges = S._edges(prefix, S.RADIUS)(mine)
        found |= {(min(a, b), max(a, b)) for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist())}
    recall = len({(a, b) for a, b in found if b == a + n}) / n
    print(f"recall at {S.RADIUS} bits: {recall:.3f}")
    assert recall >= 0.9
    assert all(np.bitwise_count(fps[a] ^ fps[b]).sum() <= S.RADIUS for a, b in found)


def test_parts_of_a_split_find_what_the_split_finds(monkeypatch):
    rng = np.random.default_rng(10)
    one = rng.integers(0, 2, (2000, 256)).astype(np.uint8)
    two = one ^ (rng.random((2000, 256)) < 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array([f.tobytes() for f in np.packbits(np.concatenate((one, two)), axis=1)], pa.binary())], ["node", "fp"])

    def components(prefix: int, part: int) -> np.ndarray:
        monkeypatch.setattr(S, "PART", part)
        table = pa.Table.from_batches(S._scatter(prefix)([batch]))
        edges = [S._edges(prefix, S.RADIUS)(table.filter(pa.compute.equal(table["part"], p))) for p in set(table["part"].to_pylist())]
        edges = pa.concat_tables(edges)
        return S.local_components(np.arange(4000), edges["a"].to_numpy(), edges["b"].to_numpy())

    whole = components(0, 10**9)
    assert (whole[2000:] == np.arange(2000)).mean() > 0.9
    for prefix, part in ((0, 500), (3, 10**9), (2, 200)):
        assert (components(prefix, part) == whole).all()


def _entries(fps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(fps), S._ENTRY)
    out["node"], out["fp"] = np.arange(len(fps)), fps
    return out


def test_one_crowded_value_does_not_slow_the_others():
    """Many values that two far fingerprints share, and one that 1500 share: no pair is near, and each is tried once."""
    rng = np.random.default_rng(11)
    fps = rng.integers(0, 256, (101_500, 32), dtype=np.uint8)
    fps[1:100_000:2, :3] = fps[0:100_000:2, :3]
    fps[100_000:, :3] = 7
    began = time.process_time()
    a, _ = S.split_edges(_entries(fps), 0, S.RADIUS, 0, 0)
    assert len(a) == 0 and time.process_time() - began < 15


def test_a_task_holds_little_at_once():
    """One split of 190,000 fingerprints in under 150 MB besides its rows, with the pairs that are there."""
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 256, (190_000, 32), dtype=np.uint8)
    fps[95_000:] = fps[:95_000]
    fps[95_000:, 31] ^= 1
    table = pa.table({"part": pa.array([0]), "entries": pa.array([_entries(fps).tobytes()], pa.binary())})
    tracemalloc.start()
    try:
        edges = S._edges(0, S.RADIUS)(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(f"{peak / 1e6:.0f} MB")
    assert {(min(p), max(p)) for p in zip(edges["a"].to_pylist(), edges["b"].to_pylist())} >= {(i, i + 95_000) for i in range(95_000)}
    assert peak < 150e6


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " .,; "), (4, "one word"), (5, "one word"), (None, "one word"), (6, "another text altogether"), (6, "another text altogether")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.group_id, r.kept, r.copies) for r in got) == [(0, 4, False, 3), (1, 1, True, 1), (2, 2, True, 1), (3, 3, True, 1), (4, 4, True, 3), (5, 4, False, 3), (6, 6, False, 2), (6, 6, True, 2)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 6]


def test_fingerprints_do_not_depend_on_the_batch():
    texts = ["Some words of a text", "Other words", "", "Some words of a text"]
    whole, has = S.fingerprint_bits(*B.flat(pa.array(texts)))
    assert has.tolist() == [True, True, False, True]
    for i, t in enumerate(texts):
        assert (S.fingerprint_bits(*B.flat(pa.array([t])))[0][0] == whole[i]).all()
