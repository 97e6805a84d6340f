"""Best-fit packing of documents into sequences of a fixed capacity.

A document's length is its number of words (maximal runs of non-white-space), or
what a column of the caller's says, such as op7's token counts.
Documents longer than the capacity are cut into pieces of the full capacity and
a rest; a full piece is a bin of its own. The other pieces are planned on the
histogram of their lengths alone, whose size is bounded by the capacity
whatever the number of documents:

1. exact-complement hashing: from the longest length down, the gap that a piece
   leaves is looked up among single, pair and triple sums of lengths that are
   still available; a combination that fills the gap exactly is used as often
   as its counts allow;
2. what no combination completes goes by best fit, longest first: the smallest
   gap that holds the piece, or a new bin.

The plan says which bins the r-th piece of a length belongs to; pieces are
numbered within their length in a fixed order and looked up by binary search.
The numbering is spread over slices of each length, so that a frequent length
doesn't fall to one task.

Defined results: null, empty and blank texts have length 0 and are in no bin, nor
are rows whose given length is null or below 1.
Repeated rows are pieces each on their own; which of equal pieces goes where is
the same in every run for the same rows. Null ids are allowed. Other columns
are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, doc_hash

CAPACITY = 2048
#: Pieces of one length that are numbered in one slice, at about most.
SLICE = 1_000_000


class _Available:
    """Counts of lengths, with single, pair and triple sums looked up among those left."""

    def __init__(self, counts: np.ndarray) -> None:
        self.count = counts.astype(np.int64)
        self.capacity = len(counts) - 1
        self._index()

    def _index(self) -> None:
        """Which sums two and three available lengths make. Counts only fall, so an old index says too much, never too little."""
        there = self.count > 0
        bits = int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")
        pairs = 0
        size = self.capacity + 1
        for a in np.flatnonzero(there).tolist():
            pairs |= bits << a
        pairs &= (1 << size) - 1
        triples = 0
        for a in np.flatnonzero(there).tolist():
            triples |= pairs << a
        sums = [np.unpackbits(np.frombuffer((x & ((1 << size) - 1)).to_bytes((size + 7) // 8, "little"), np.uint8), bitorder="little")[:size].astype(bool) for x in (pairs, triples)]
        self.pair, self.triple = sums

    def _two(self, total: int, spare: int = 0) -> tuple[int, int] | None:
        """The pair of this sum with the longest member; spare is a length of which one is in use."""
        a = np.arange((total + 1) // 2, total)
        b = total - a
        ok = (self.count[a] > (a == spare)) & (self.count[b] - (b == spare) > (a == b))
        at = np.flatnonzero(ok)
        return (int(a[at[-1]]), int(total - a[at[-1]])) if len(at) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that make gap exactly, longest first."""
        if gap <= 0:
            return None
        if self.count[gap]:
            return (gap,)
        if gap >= 2 and self.pair[gap] and (two := self._two(gap)):
            return two
        if gap < 3 or not self.triple[gap]:
            return None
        first = np.arange(gap - 2, 0, -1)
        for c in first[(self.count[first] > 0) & self.pair[gap - first]]:
            if two := self._two(gap - int(c), int(c)):
                return (int(c), *two)
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many bins have each, for counts[length] pieces of each length below or at capacity."""
    have = _Available(np.concatenate((counts, np.zeros(max(0, capacity + 1 - len(counts)), np.int64)))[: capacity + 1])
    bins: list[tuple[tuple[int, ...], int]] = []
    stale = 0
    for length in range(capacity, 0, -1):
        while n := int(have.count[length]):
            if length == capacity:
                bins.append(((length,), n))
                have.count[length] = 0
                break
            have.count[length] -= 1  # the piece whose gap is to be filled
            others = have.fill(capacity - length)
            have.count[length] += 1
            if others is None:
                break
            need = np.bincount((length, *others), minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((have.count[used] // need[used]).min())
            have.count[used] -= need[used] * times
            bins.append(((length, *others), times))
            stale += 1
            if stale % 64 == 0:
                have._index()
    # best fit: gaps in order, each with the patterns that leave it
    gaps: list[int] = []
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def leave(pattern: tuple[int, ...], n: int, gap: int) -> None:
        if gap == 0:
            bins.append((pattern, n))
            return
        if gap not in open_:
            bisect.insort(gaps, gap)
            open_[gap] = []
        open_[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        n = int(have.count[length])
        while n:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                per = capacity // length
                if n >= per:  # new bins are filled with the length as long as it fits best
                    leave((length,) * per, n // per, capacity - per * length)
                    n -= n // per * per
                else:
                    leave((length,) * n, 1, capacity - n * length)
                    n = 0
                continue
            gap = gaps[i]
            pattern, many = open_[gap].pop()
            take = min(n, many)
            if many > take:
                open_[gap].append((pattern, many - take))
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            n -= take
            leave((*pattern, length), take, gap - length)
    for gap in gaps:
        bins += open_[gap]
    return bins


def _intervals(bins: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranks [from, to) of its pieces, the bin of the first and the place in the bin."""
    used = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for pattern, n in bins:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def _assign(where: dict[str, np.ndarray]):
    shift = np.int64(1 << 46)
    keys = where["length"] * shift + where["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            i = np.searchsorted(keys, length * shift + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(where["bin"][i] + rank - where["rank"][i]), batch.column(0), batch.column(1), batch.column(2), pa.array(where["offset"][i].astype(np.int32)),
            ], ["bin_id", "doc_id", "piece", "length", "bin_offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, length_col: str | None = None) -> DataFrame:
    """(bin_id, doc_id, piece, length, bin_offset): words (or what length_col counts) [piece * capacity, + length) of a document stand at bin_offset of a bin.

    Bins of the plan come first; full pieces of long documents follow, each in a bin of its own."""
    text = col(docs, text_col)
    words = F.coalesce(F.regexp_count(text, F.lit(r"\S+")) if length_col is None else col(docs, length_col), F.lit(0)).cast("long")
    # the lengths are few bytes a document and are read several times
    sized = cut(docs.select(col(docs, id_col).cast("long").alias("doc_id"), doc_hash(text).alias("h"), words.alias("words")).where("words > 0"))
    rest = sized.withColumn("length", (F.col("words") % capacity).cast("int")).where("length > 0").withColumn("piece", F.floor(F.col("words") / capacity).cast("int"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rest.groupBy("length").count().collect():  # at most capacity rows
        counts[length] = n
    bins = plan(counts, capacity)
    planned = sum(n for _, n in bins)
    slices = max(1, math.ceil(int(counts.max()) / SLICE))
    slice_ = F.pmod(F.xxhash64("doc_id", "h"), F.lit(slices))
    numbered = rest.withColumn("slice", slice_)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("length", "slice").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "h")
    ranked = numbered.withColumn("within", F.row_number().over(inside) - 1).join(starts, ["length", "slice"]).withColumn("rank", F.col("within") + F.col("start"))
    schema = "bin_id long, doc_id long, piece int, length int, bin_offset int"
    placed = ranked.select("doc_id", "piece", "length", F.col("rank").cast("long")).mapInArrow(_assign(_intervals(bins, capacity)), schema)
    return placed.unionByName(_full(sized, capacity, planned))


def _full(sized: DataFrame, capacity: int, base: int) -> DataFrame:
    """Full pieces of long documents, numbered from base: counts by slice first, then within each slice."""
    long = sized.where(F.col("words") >= capacity).withColumn("full", F.floor(F.col("words") / capacity))
    n = long.count()
    slices = max(1, math.ceil(n / SLICE))
    long = long.withColumn("slice", F.pmod(F.xxhash64("doc_id", "h"), F.lit(slices)))
    offsets = long.groupBy("slice").agg(F.sum("full").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("slice").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = long.withColumn("within", F.coalesce(F.sum("full").over(order), F.lit(0))).join(offsets, "slice")
    each = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))))
    return each.select(
        (F.lit(base) + F.col("start") + F.col("within") + F.col("piece")).cast("long").alias("bin_id"), "doc_id", "piece",
        F.lit(capacity).cast("int").alias("length"), F.lit(0).cast("int").alias("bin_offset"),
    )
