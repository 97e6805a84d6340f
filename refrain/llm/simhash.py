"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint has 256 bits: signs of the sums of weighted random vectors
of its words (square root of the count; words of up to three bytes, mostly
function words, count an eighth). Weights are otherwise flat, so that no few
words decide the bits of a short text. Two texts are near duplicates when their
fingerprints differ in at most ``radius`` bits; groups are the connected
components of that relation.

Candidates come from multi-index hashing: sixteen segments of 24 bits are taken
from the fingerprint, two bytes apart and round its end; every fingerprint
enters the table of each segment under all values within Hamming distance one of
its own, so two fingerprints meet whenever some segment differs in at most two
bits, and their complete distance is then verified. Up to 23 bits this finds
every pair (sixteen segments with three bits each make 48, and a bit is in two
segments at most); at the default radius single pairs can be missed. The tests hold
the search against all pairs of fingerprints at exactly the radius (recall at
least 0.9), and the groups against word 3-gram Jaccard similarity by brute
force.

The tables live where they are probed: a table is split by the leading bits of
its values, and only values whose leading bits are flipped travel to another
split. Equal fingerprints are one entry. In a split, members of one component
already found aren't compared again, and only a spanning forest leaves it, so
a group of thousands of copies costs edges in proportion to its size.

Defined results: a text without any word (null, empty, blank or punctuation
only) has no fingerprint and is a group of its own. Repeated rows are copies
of each other; one of identical rows is kept. Null ids are allowed and come last in order. Columns other than
id and text are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as B
from .common import col, cut, doc_hash, pieces
from .components import connected, local_components

RADIUS = 40
SEGMENTS = 16
#: Bits of a segment, and bytes from one segment to the next.
BITS = 24
STRIDE = 2
#: Fingerprints that one split of a table holds at about most, and that are compared in memory at a time.
SPLIT = 400_000
PART = 60_000
_ENTRY = np.dtype([("node", "<i8"), ("fp", "u1", 32)])
_GAP = B.SPACE.copy()
_GAP[33:48] = _GAP[58:65] = _GAP[91:97] = _GAP[123:127] = True
_SIGN = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2) - 1
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def fingerprint_bits(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of 32 bytes) of the texts in data, and which rows have one."""
    n = len(offs) - 1
    total = np.zeros((n, 256))
    starts, ends, row = B.tokens(B.lower(data), offs, _GAP)
    has = np.zeros(n, bool)
    if len(starts):
        has[row] = True
        # row, 40 bits of the word's hash, length: sorting groups equal words of a row
        words = B.spans(B.lower(data), starts, ends)
        keys = (row.astype(np.uint64) << np.uint64(44)) | ((words >> np.uint64(24)) << np.uint64(4)) | np.minimum(ends - starts, 15).astype(np.uint64)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        length = (keys & np.uint64(15)).astype(np.int64)
        # whole weights: sums are exact, so equal texts have equal fingerprints whatever batch they are in
        weight = np.rint(np.sqrt(count) * np.where(length > 3, 64, 8))
        at = (keys >> np.uint64(44)).astype(np.int64)
        word = keys & np.uint64((1 << 44) - 1)
        for a in range(0, len(keys), 4096):
            w, r, k = weight[a : a + 4096], at[a : a + 4096], word[a : a + 4096]
            kind = np.float32 if w.sum() < 1 << 24 else np.float64
            bits = B.mix(k[:, None] * np.uint64(0xD6E8FEB86659FD93) + _SEEDS)
            signs = _SIGN[bits.view(np.uint8).reshape(len(k), 32)].reshape(len(k), 256).astype(kind, copy=False)
            signs *= w[:, None].astype(kind)
            begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            total[r[begin]] += np.add.reduceat(signs, begin, axis=0)
    return np.packbits(total > 0, axis=1), has


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 2):
            bits, has = fingerprint_bits(*B.flat(piece.column(2)))
            values = pa.array([b.tobytes() if h else None for b, h in zip(bits, has)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), values], ["id", "h", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): id, hash of the text, fingerprint or null, a row for each row of docs."""
    text = col(docs, text_col)
    return docs.select(col(docs, id_col).cast("long").alias("id"), doc_hash(text).alias("h"), text.alias("text")).mapInArrow(_fingerprints, "id long, h long, fp binary")


def segment(fp: np.ndarray, s: int) -> np.ndarray:
    """The value of segment s of each fingerprint."""
    byte = [fp[:, (s * STRIDE + k) % 32].astype(np.uint32) for k in range(BITS // 8)]
    return (byte[0] << np.uint32(16)) | (byte[1] << np.uint32(8)) | byte[2]


def _scatter(prefix: int):
    """Packs the entries of each split of each segment's table, node and fingerprint: a fingerprint goes to the split
    of its own value and to those of the values with one of the leading bits flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = np.zeros(batch.num_rows, _ENTRY)
            entry["node"], entry["fp"] = batch.column(0).to_numpy(), B.flat(batch.column(1))[0].reshape(-1, 32)
            part = []
            for s in range(SEGMENTS):
                lead = (segment(entry["fp"], s) >> np.uint32(BITS - prefix)).astype(np.int64)
                part += [(lead ^ f) + (s << prefix) for f in (0, *(1 << b for b in range(prefix)))]
            if not batch.num_rows:
                continue
            p = np.concatenate(part)
            order = np.argsort(p, kind="stable")
            p, e = p[order], entry[order % batch.num_rows]
            begin = np.flatnonzero(np.diff(p, prepend=-1))
            end = np.append(begin[1:], len(p))
            yield pa.RecordBatch.from_arrays([pa.array(p[begin], pa.int64()), pa.array([e[a:b].tobytes() for a, b in zip(begin, end)], pa.binary())], ["part", "entries"])

    return run


def split_edges(entries: np.ndarray, prefix: int, radius: int, s: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs that meet where the values of segment s lead with prefix bits equal to lead.

    Entries whose own value leads otherwise are visitors, in the place of their value with that one bit flipped."""
    ids, at = np.unique(entries["node"], return_inverse=True)
    fps = np.zeros((len(ids), 4), np.uint64)
    fps[at] = np.ascontiguousarray(entries["fp"]).view("<u8").reshape(-1, 4)
    own = segment(entries["fp"], s).astype(np.uint64)
    rest = np.uint64(BITS - prefix)
    home = own >> rest == np.uint64(lead)
    value = (own & ((np.uint64(1) << rest) - np.uint64(1))) | (np.uint64(lead) << rest)
    label = np.arange(len(ids))

    hv, ha = value[home], at[home].astype(np.uint64)
    keys = np.empty(len(at) + len(hv) * (BITS - prefix), np.uint64)
    keys[: len(at)] = (value << np.uint64(32)) | at.astype(np.uint64)
    for b in range(BITS - prefix):
        keys[len(at) + b * len(hv) : len(at) + (b + 1) * len(hv)] = ((hv ^ np.uint64(1 << b)) << np.uint64(32)) | ha
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    member, key = (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), (keys >> np.uint64(32)).astype(np.int32)
    del keys
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(begin, len(key)))
    del key, begin

    def near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(u), bool)
        for a in range(0, len(u), 1 << 16):
            x, y = u[a : a + (1 << 16)], v[a : a + (1 << 16)]
            # most pairs differ in more bits than allowed in their first half already
            half = np.flatnonzero(np.bitwise_count(fps[x, :2] ^ fps[y, :2]).sum(1) <= radius)
            ok[a + half] = np.bitwise_count(fps[x[half]] ^ fps[y[half]]).sum(1) <= radius
        return ok

    def join(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
        ok = near(u, v)
        if ok.any():
            label = local_components(label, u[ok], v[ok])

    # a step pairs members that stand so far apart in their group: a group is dropped when it is through, and when all
    # its members are of one component, so that steps cost what pairs there are
    step = 1
    while True:
        stay = size > step
        if step < 16 or step % 16 == 0:
            begin = np.cumsum(size) - size
            lowest, highest = (f.reduceat(label[member], begin) if len(begin) else begin for f in (np.minimum, np.maximum))
            stay &= lowest != highest
        if not stay.all():
            member, size = member[np.repeat(stay, size)], size[stay]
        if not len(size):
            break
        group = np.repeat(np.arange(len(size), dtype=np.int32), size)
        same = group[step:] == group[:-step]
        join(member[step:][same], member[:-step][same])
        step += 1
    inside = label != np.arange(len(ids))
    return ids[inside], ids[label[inside]]


def _edges(prefix: int, radius: int):
    def run(table: pa.Table) -> pa.Table:
        s, lead = divmod(table.column("part")[0].as_py(), 1 << prefix)
        entries = np.concatenate([np.zeros(0, _ENTRY), *[np.frombuffer(B.flat(c)[0].tobytes(), _ENTRY) for c in table.column("entries").chunks]])
        del table
        # a split of more than PART entries is split again by further bits, in memory: one part after another
        more = min(BITS - prefix - 1, max(0, math.ceil(math.log2(max(len(entries), 1) / PART))))
        found = []
        if more == 0:
            found.append(split_edges(entries, prefix, radius, s, lead))
        else:
            depth = prefix + more
            own = (segment(entries["fp"], s) >> np.uint32(BITS - depth)).astype(np.int64)
            for tail in range(1 << more):
                # at most one of the leading bits differs; visitors differ in the first ones already
                here = np.bitwise_count(own ^ ((lead << more) | tail)) <= 1
                found.append(split_edges(entries[here], depth, radius, s, (lead << more) | tail))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if more:  # the parts' forests made one
            ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = local_components(np.arange(len(ids)), at[: len(a)], at[len(a) :])
            inside = label != np.arange(len(ids))
            a, b = ids[inside], ids[label[inside]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, h, group_id, kept, copies) for each row of docs: group_id is the least id of the group, kept marks the
    row of that id (of several texts under that id the one with the least hash, of identical rows one), copies counts
    the group's rows."""
    prints = cut(fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    # a number for each fingerprint: equal numbers mean equal fingerprints, which hashes wouldn't
    nodes = cut(prints.where("fp is not null").select("fp").distinct().withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    prefix = max(0, math.ceil(math.log2(max(n, 1) / SPLIT)))
    edges = nodes.select("node", "fp").mapInArrow(_scatter(prefix), "part long, entries binary").groupBy("part").applyInArrow(_edges(prefix, radius), "a long, b long")
    # the members of a group of several fingerprints are found by the number of its root
    linked = connected(edges)
    linked = linked.unionAll(linked.select(F.col("root").alias("node"), "root").distinct())
    roots = nodes.join(linked, "node").select("fp", "root")
    grouped = prints.where("fp is not null").join(roots, "fp", "left").select("id", "h", "row", "root", F.when(F.col("root").isNull(), F.col("fp")).alias("alike"))
    of = F.struct(F.col("id").isNull().alias("unknown"), "id", "h", "row")
    heads = grouped.groupBy("root", "alike").agg(F.min(of).alias("head"), F.count("*").alias("copies"))
    # a group of one needs no row of heads: the join is with the groups of several
    several = heads.where("copies > 1").select(F.col("root").alias("r"), F.col("alike").alias("l"), "head", "copies")
    found = grouped.join(several, F.col("root").eqNullSafe(F.col("r")) & F.col("alike").eqNullSafe(F.col("l")), "left")
    alone = F.col("copies").isNull()
    out = found.select(
        "id", "h",
        F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("group_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )
    return out.unionAll(prints.where("fp is null").select("id", "h", F.col("id").alias("group_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, kept, copies), a row for each row of docs."""
    return groups(docs, id_col, text_col, radius).select(F.col("id").alias("doc_id"), "group_id", "kept", "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, all columns as they were."""
    found = groups(docs, id_col, text_col, radius)
    # one row for each (id, text) that isn't simply kept: to be dropped, or held by several rows of which one stays
    verdict = cut(found.where("copies > 1").groupBy("id", "h").agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")).where("not _kept or _rows > 1"))
    names = list(docs.columns)
    side = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = side[f"c{names.index(id_col)}"].cast("long"), side[f"c{names.index(text_col)}"]
    side = side.withColumn("_h", doc_hash(text)).withColumn("_id", key)
    joined = side.join(verdict.hint("shuffle_hash").withColumnsRenamed({"id": "_vid", "h": "_vh"}), F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_h") == F.col("_vh")), "left")
    plain = joined.where("_vh is null")
    one = joined.where("_kept").dropDuplicates(["_id", "_h"])
    return plain.unionByName(one).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
