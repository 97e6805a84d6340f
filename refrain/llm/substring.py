"""Exact repeated passages by fixed-block anchors.

Words are maximal runs of bytes other than ASCII white space; windows of words
are equal when the 64-bit hashes of their bytes are. A window is ``min_words`` (L) consecutive words of one text; it is a
repeat when an equal window comes earlier, in the order of (id, hash of the
text, position), nulls last. Its source is the equal window before it in the
same text, where there is one, else the first of all. A repeat in the result is
a maximal run of such windows whose sources run in step: words
[start, start + n_words) of a text equal words [first_start, ...) of its source.
A text that repeats one period throughout is one repeat, from its second period on.

Search: every text is cut into non-overlapping reference blocks of
``block = (L + 1) // 2`` words, and every rolling window of block words probes them.
As L >= 2 * block - 1, any repeat of L words holds a whole block of its other
occurrence. Probes and blocks meet by hash, packed as arrays of 32-bit hashes
and positions for each of as many hash ranges as the corpus needs, which is
why millions of probes cost a few bytes each. Hits are then extended: all
windows of L words around a hit meet under a 64-bit hash in the range of their
least hit, which depends on the words alone, so the windows of one passage
meet in one place in all its copies and the first of each is found without
comparing copies pairwise. Texts are handled in bundles, and of a bundle's equal
windows one goes to that place; the others follow it. The work is linear in the
corpus whatever the number of copies.

Defined results: null and empty texts, and texts of fewer than L words, hold no
repeat. Rows with equal id and text are one text: all get the same result.
Texts that repeat themselves keep one period. Null ids are allowed and come
last. Other columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as B
from .common import col, doc_hash, pieces

MIN_WORDS = 50
#: Windows that one hash range holds at about most, and that a task packs at a time.
RANGE = 1_500_000
PACK = 1_000_000
_REPEATS = "id long, h long, start int, n_words int, first_id long, first_h long, first_start int"


def _pack(values: np.ndarray) -> bytes:
    """32-bit differences, a plane for each byte: the high planes are zeros that compression removes."""
    return np.diff(values.astype(np.int32), prepend=np.int32(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)


def _blobs(group: np.ndarray, doc: np.ndarray, pos: np.ndarray, value: np.ndarray, ids: np.ndarray, hs: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    """A row for each hash range: its texts, how many windows each has there, their positions and hashes."""
    order = np.argsort(group.astype(np.uint16) if int(group.max(initial=0)) < 1 << 16 else group, kind="stable")
    group, doc, pos, value = group[order], doc[order], pos[order], value[order]
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    rows: list[tuple] = []
    for a, b in zip(begin, np.append(begin[1:], len(group))):
        first = np.flatnonzero(np.diff(doc[a:b], prepend=-1)) + a
        d = doc[first]
        rows.append((int(group[a]), ids[d].tobytes(), hs[d].tobytes(), null[d].tobytes(), np.diff(np.append(first, b)).astype("<i4").tobytes(), _pack(pos[a:b]), value[a:b].tobytes()))
    kinds = [pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], pa.nulls(len(rows), pa.binary())], _BLOB_NAMES)


_BLOB_NAMES = ["q", "ids", "hs", "nulls", "counts", "pos", "hashes", "runs"]


_BLOBS = "q long, ids binary, hs binary, nulls binary, counts binary, pos binary, hashes binary, runs binary"
#: A run of n windows of a text (its id, whether that is null, its hash) in step with another text's.
_RUN = np.dtype([("null", "u1"), ("id", "<i8"), ("h", "<i8"), ("start", "<i4"), ("n", "<i4"), ("first_null", "u1"), ("first_id", "<i8"), ("first_h", "<i8"), ("first_start", "<i4")])
_KEY = np.dtype([("null", "u1"), ("id", "<i8"), ("h", "<i8")])
_LOW = np.int64(0xFFFFFFFF)


def _numbered(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different texts of _KEY rows in order (nulls last), and each row's number among them."""
    order = np.lexsort((texts["h"], texts["id"], texts["null"]))
    sorted_ = texts[order]
    new = np.ones(len(order), bool)
    for c in ("null", "id", "h"):
        new[1:] &= sorted_[c][1:] == sorted_[c][:-1]
    new[1:] = ~new[1:]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return sorted_[new], rank


def _sources(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows (place: text << 32 | position, value: hash), each place once, sorted by hash: an index of it, whether it
    is the first with its hash, and its source: the one before it in its own text, else the first."""
    order = np.lexsort((place, value))
    p, v = place[order], value[order]
    stay = np.ones(len(order), bool)
    stay[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])  # rows of equal id and text are one text
    order, p, v = order[stay], p[stay], v[stay]
    head = np.ones(len(order), bool)
    head[1:] = v[1:] != v[:-1]
    source = p[np.flatnonzero(head)][np.cumsum(head) - 1] if len(p) else p
    own = np.flatnonzero(~head)
    own = own[p[own] >> 32 == p[own - 1] >> 32]
    source[own] = p[own - 1]
    return order, head, source


def _in_step(p: np.ndarray, s: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Runs of places whose sources are in step; texts are _KEY rows by number."""
    order = np.argsort(p, kind="stable")
    p, s = p[order], s[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(s) != 1)
    head = np.flatnonzero(new)
    out = np.zeros(len(head), _RUN)
    for side, at in (("", p[head]), ("first_", s[head])):
        for c in ("null", "id", "h"):
            out[side + c] = texts[c][at >> 32]
        out[side + "start"] = at & _LOW
    out["n"] = np.diff(np.append(head, len(p)))
    return out


def _bucket(null: np.ndarray, id_: np.ndarray, h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of the ranges a text falls to."""
    return (B.mix(B.mix(id_.astype(np.int64).view(np.uint64) + null) ^ h.astype(np.int64).view(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def _dealt(runs: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    runs, bucket = runs[order], bucket[order]
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), runs[a:b].tobytes()) for a, b in zip(begin, np.append(begin[1:], len(runs)))]


def _windows(runs: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sources of every window of runs whose texts have these numbers."""
    n = runs["n"].astype(np.int64)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(doc << 32 | runs["start"].astype(np.int64), n) + k, np.repeat(first << 32 | runs["first_start"].astype(np.int64), n) + k


class _Texts:
    """All windows of one hash range: a table of texts in order, and of each window its text's rank, position and hash."""

    def __init__(self, table: pa.Table, hash_kind: str) -> None:
        def whole(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(B.flat(table.column(name))[0].tobytes(), kind)

        ids, hs, null, counts = whole("ids", "<i8"), whole("hs", "<i8"), whole("nulls", "u1"), whole("counts", "<i4")
        texts = np.zeros(len(ids), _KEY)
        texts["null"], texts["id"], texts["h"] = null, ids, hs
        self.texts, rank = _numbered(texts)
        self.rank = np.repeat(rank, counts)
        self.pos = np.concatenate([_unpack(x) for x in table.column("pos").to_pylist()] or [np.zeros(0, np.int64)])
        self.hash = whole("hashes", hash_kind)


def _words(piece: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and index in the row of each word."""
    data, offs = B.flat(piece.column(text))
    starts, ends, row = B.tokens(data, offs)
    first = np.searchsorted(row, np.arange(piece.num_rows))
    return B.spans(data, starts, ends), row, np.arange(len(row)) - first[row] if len(row) else row


def _keys(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = piece.column(0).is_null().to_numpy(zero_copy_only=False).astype("u1")
    return piece.column(0).fill_null(0).to_numpy(), piece.column(1).to_numpy(), null


def _probes(block: int, min_words: int, ranges: int):
    """Packs the rolling windows of block words of every text that can hold a repeat.

    Texts are packed in bundles, named by partition and number. In a bundle a window is its place among all its words, and the lowest bit of its hash
    says whether it is a reference block. The bundle's own table of texts goes to one range, which passes it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = words_before = made = 0
        partition = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            group, place, value, ids, hs, null, count = (np.concatenate([h[i] for h in held]) for i in range(7))
            bundle = partition + made
            order = np.argsort(group.astype(np.uint16) if ranges <= 1 << 16 else group, kind="stable")
            group, place, value = group[order], place[order], value[order]
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            rows = [(int(group[a]), bundle, _pack(place[a:b]), value[a:b].tobytes(), None) for a, b in zip(begin, np.append(begin[1:], len(group)))]
            texts = np.zeros(len(ids), _TEXT)
            texts["id"], texts["h"], texts["null"], texts["words"] = ids, hs, null, count
            rows.append((bundle % ranges, bundle, None, None, texts.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["q", "bundle", "place", "hashes", "texts"])

        for batch in batches:
            for piece in pieces(batch, 2):
                words, row, index = _words(piece, 2)
                if len(words) >= block:
                    w = B.windows(words, block)
                    count = np.bincount(row, minlength=piece.num_rows)
                    ok = (row[: len(w)] == row[block - 1 :]) & (count[row[: len(w)]] >= min_words)
                    w = w[ok]
                    value = (w.astype("<u4") & ~np.uint32(1)) | (index[: len(ok)][ok] % block == 0)
                    group = ((w >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
                    held.append((group, (np.flatnonzero(ok) + words_before).astype(np.int32), value.astype("<u4"), *_keys(piece), count))
                    size, words_before = size + len(w), words_before + len(words)
                if size >= PACK:
                    yield out()
                    held, size, words_before, made = [], 0, 0, made + 1
        if size:
            yield out()

    return run


_TEXT = np.dtype([("id", "<i8"), ("h", "<i8"), ("null", "u1"), ("words", "<i4")])


def _hits(table: pa.Table) -> pa.Table:
    """Windows of a hash range that equal some reference block other than themselves, packed by bundle."""
    packed = table.filter(pc.is_valid(table.column("place")))
    passed = table.filter(pc.is_valid(table.column("texts"))).select(["bundle", "texts"])
    places = [_unpack(x) for x in packed.column("place").to_pylist()]
    counts = np.array([len(x) for x in places], np.int64)
    place = np.concatenate(places or [np.zeros(0, np.int64)]).astype(np.int32)
    value = np.frombuffer(B.flat(packed.column("hashes"))[0].tobytes(), "<u4")
    bundle = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    order = np.argsort(value >> 1)
    value = value[order]
    begin = np.flatnonzero(np.concatenate(([True], value[1:] >> 1 != value[:-1] >> 1))) if len(value) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(value)))
    found = (size > 1) & (np.maximum.reduceat(value & 1, begin) == 1) if len(begin) else np.zeros(0, bool)
    hit = order[np.repeat(found, size)]
    hit = hit[np.argsort(bundle[hit], kind="stable")]
    first = np.flatnonzero(np.diff(bundle[hit], prepend=-1))
    names = packed.column("bundle").to_numpy()
    where = pa.table({
        "bundle": pa.array(names[bundle[hit[first]]], pa.int64()),
        "hits": pa.array([np.sort(place[hit[a:b]]).astype("<i4").tobytes() for a, b in zip(first, np.append(first[1:], len(hit)))], pa.binary()),
        "texts": pa.nulls(len(first), pa.binary()),
    })
    return pa.concat_tables([where, pa.table({"bundle": passed.column("bundle"), "hits": pa.nulls(passed.num_rows, pa.binary()), "texts": passed.column("texts").cast(pa.binary())})])


def _by_text(table: pa.Table) -> pa.Table:
    """Hits of a bundle as places in its texts."""
    texts = np.frombuffer(b"".join(x for x in table.column("texts").to_pylist() if x), _TEXT)
    place = np.unique(np.frombuffer(b"".join(x for x in table.column("hits").to_pylist() if x), "<i4"))
    first = np.cumsum(texts["words"]) - texts["words"]
    at = np.searchsorted(first, place, "right") - 1
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    t = texts[at[begin]]
    pos = (place - first[at]).astype("<i4")
    return pa.table({
        "id": pa.array(t["id"], pa.int64(), mask=t["null"] == 1), "h": pa.array(t["h"], pa.int64()),
        "hits": pa.array([pos[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(place)))], pa.binary()),
    })


def _extended(block: int, min_words: int, ranges: int):
    """Packs all windows of min_words words around the hits of texts, in the range of the least hit in each.

    Of windows of one hash only the first in a bundle of texts goes there; the others' sources are found within the
    bundle, and their runs go to the bucket of the text that holds the first one, to be led on from there. So a passage
    that very many texts share meets in one place once for each bundle, not for each text."""
    reach = min_words - block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = texts = 0

        def out() -> Iterator[pa.RecordBatch]:
            group, doc, pos, value, ids, hs, null = (np.concatenate([h[i] for h in held]) for i in range(7))
            key = np.zeros(len(ids), _KEY)
            key["null"], key["id"], key["h"] = null, ids, hs
            names, rank = _numbered(key)
            place = rank[doc] << 32 | pos
            order, head, source = _sources(place, value)
            lead = np.sort(order[head])
            yield _blobs(group[lead], doc[lead], pos[lead], value[lead], ids, hs, null)
            runs = _in_step(place[order[~head]], source[~head], names)
            dealt = _dealt(runs, _bucket(runs["first_null"], runs["first_id"], runs["first_h"], ranges))
            empty = pa.nulls(len(dealt), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in dealt], pa.int64()), *[empty] * 6, pa.array([d[1] for d in dealt], pa.binary())], _BLOB_NAMES)

        for batch in batches:
            for piece in pieces(batch, 2):
                words, row, index = _words(piece, 2)
                hits = piece.column(3).to_pylist()
                n = np.bincount(row, minlength=piece.num_rows)
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                at = [first[i] + np.frombuffer(h, "<i4") for i, h in enumerate(hits) if h]
                if not at or len(words) < min_words:
                    continue
                at = np.concatenate(at).astype(np.int64)
                small = B.windows(words, block)[at]
                least = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
                for k in range(reach + 1):
                    i = at - k
                    ok = (index[at] >= k) & (index[i] + min_words <= n[row[at]])
                    least[i[ok]] = np.minimum(least[i[ok]], small[ok])
                window = np.flatnonzero(least != np.iinfo(np.uint64).max)
                if len(window):
                    w = B.windows(words, min_words, 0xD1342543DE82EF95)[window]
                    group = (B.mix(least[window]) % np.uint64(ranges)).astype(np.int64)
                    held.append((group, row[window] + texts, index[window], w.astype("<u8"), *_keys(piece)))
                    size, texts = size + len(w), texts + piece.num_rows
                if size >= PACK // 2:
                    yield from out()
                    held, size, texts = [], 0, 0
        if size:
            yield from out()

    return run


def _first(ranges: int):
    """Runs of the windows of a range that come again, in step with their sources, in the buckets of their texts; runs
    that were found in bundles are passed on."""

    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(pc.is_valid(table.column("runs")))
        t = _Texts(table.filter(pc.is_valid(table.column("hashes"))), "<u8")
        place = t.rank << 32 | t.pos
        order, head, source = _sources(place, t.hash)
        runs = _in_step(place[order[~head]], source[~head], t.texts)
        dealt = _dealt(runs, _bucket(runs["null"], runs["id"], runs["h"], ranges))
        return pa.table({
            "bucket": pa.concat_arrays([pa.array([d[0] for d in dealt], pa.int64()), *passed.column("q").chunks]),
            "found": pa.array([*[d[1] for d in dealt], *[None] * passed.num_rows], pa.binary()),
            "led": pa.array([*[None] * len(dealt), *passed.column("runs").to_pylist()], pa.binary()),
        })

    return run


def _led_on(table: pa.Table) -> pa.Table:
    """All runs of a bucket: those whose sources are final, and those found in bundles, led on from the first window in
    the bundle to the source that has."""
    found, led = (np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), _RUN) for c in ("found", "led"))
    sides = [(r, side) for r in (found, led) for side in ("", "first_")]
    key = np.zeros(sum(len(r) for r, _ in sides), _KEY)
    for c in ("null", "id", "h"):
        key[c] = np.concatenate([r[side + c] for r, side in sides])
    names, number = _numbered(key)
    doc, first, own, lead = np.split(number, np.cumsum([len(r) for r, _ in sides])[:-1])
    p, s = _windows(led, own, lead)
    if len(found) and len(p):
        known, source = _windows(found, doc, first)
        order = np.argsort(known, kind="stable")
        known, source = known[order], source[order]
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        # a source in the same text is final
        on = (known[at] == s) & (p >> 32 != s >> 32)
        s = np.where(on, source[at], s)
    p, once = np.unique(p, return_index=True)
    runs = np.concatenate((found, _in_step(p, s[once], names)))
    out = {}
    for side in ("", "first_"):
        out |= {f"{side}id": pa.array(runs[side + "id"], pa.int64(), mask=runs[side + "null"] == 1), f"{side}h": pa.array(runs[side + "h"]), f"{side}start": pa.array(runs[side + "start"])}
    return pa.table({**{c: out[c] for c in ("id", "h", "start")}, "n": pa.array(runs["n"]), **{c: out[c] for c in ("first_id", "first_h", "first_start")}})


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _side(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(docs, text_col)
    return docs.select(col(docs, id_col).cast("long").alias("id"), doc_hash(text).alias("h"), text.alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, start, n_words, first_id, first_h, first_start) of every repeat; positions are words from 0."""
    block = max(1, (min_words + 1) // 2)
    side = _side(docs, id_col, text_col)
    # a range's share follows from the corpus itself: about six bytes to a word
    total = side.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(total / 6 / RANGE))
    probes = side.where("text is not null").mapInArrow(_probes(block, min_words, ranges), "q long, bundle long, place binary, hashes binary, texts binary")
    hits = probes.groupBy("q").applyInArrow(_hits, "bundle long, hits binary, texts binary")
    # rows with equal id and text have equal hits
    by_text = hits.groupBy("bundle").applyInArrow(_by_text, "id long, h long, hits binary").groupBy("id", "h").agg(F.first("hits").alias("hits"))
    right = by_text.hint("shuffle_hash").withColumnsRenamed({"id": "hid", "h": "hh"})
    around = side.join(right, _same(F.col("id"), F.col("hid")) & (F.col("h") == F.col("hh"))).select("id", "h", "text", "hits")
    runs = around.mapInArrow(_extended(block, min_words, ranges), _BLOBS).groupBy("q").applyInArrow(_first(ranges), "bucket long, found binary, led binary")
    found = runs.groupBy("bucket").applyInArrow(_led_on, _REPEATS.replace("n_words", "n"))
    # runs that were cut where the least hit changes are put together again
    found = found.distinct().withColumn("shift", F.col("start") - F.col("first_start"))
    by = Window.partitionBy("id", "h", "first_id", "first_h", "shift").orderBy("start")
    run = F.sum(F.when(F.col("start") > F.lag(F.col("start") + F.col("n")).over(by), 1).otherwise(0)).over(by)
    whole = found.withColumn("run", run).groupBy("id", "h", "first_id", "first_h", "shift", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.min("first_start").alias("first_start"))
    return whole.select("id", "h", "start", (F.col("stop") - F.col("start") - 1 + min_words).cast("int").alias("n_words"), "first_id", "first_h", "first_start")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first_start): words [start, start + n_words) of doc_id stand earlier in first_doc_id."""
    return repeats(docs, id_col, text_col, min_words).select(F.col("id").alias("doc_id"), "start", "n_words", F.col("first_id").alias("first_doc_id"), "first_start")


def _removed(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; the white space after a removed word goes with it."""
    out = []
    for text, runs in zip(texts.to_pylist(), spans.to_pylist()):
        if text is None or not runs:
            out.append(text)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        starts, _, _ = B.tokens(data, np.array([0, len(data)]))
        edge = np.append(starts, len(data))
        drop = np.zeros(len(starts) + 1, np.int32)
        for r in runs:
            drop[r["start"]] += 1
            drop[r["start"] + r["n_words"]] -= 1
        gone = np.cumsum(drop)[:-1] > 0
        stay = np.ones(len(data), bool)
        for i in np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0) == 1):
            j = i + int(np.argmin(np.append(gone[i:], False)))
            stay[edge[i] : edge[j]] = False
        out.append(data[stay].tobytes().decode())
    return pa.array(out, pa.string())


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, spans = batch.num_columns - 2, batch.num_columns - 1
        for piece in pieces(batch, text):
            yield pa.RecordBatch.from_arrays([*piece.columns[:text], _removed(piece.column(text), piece.column(spans))], [*piece.schema.names[:text], "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the words of all repeats taken out, first occurrences staying; a text of which no word is left goes.

    The length column, where there is one, is set to the new number of characters of texts that changed."""
    names = list(docs.columns)
    spans = repeats(docs, id_col, text_col, min_words).groupBy("id", "h").agg(F.collect_list(F.struct("start", "n_words")).alias("spans")).withColumnsRenamed({"id": "sid", "h": "sh"})
    side = docs.toDF(*[f"c{i}" for i in range(len(names))])
    t = names.index(text_col)
    key, text = side[f"c{names.index(id_col)}"].cast("long"), side[f"c{t}"]
    joined = side.join(spans.hint("shuffle_hash"), _same(key, F.col("sid")) & (doc_hash(text) == F.col("sh")), "left")
    rest = [f"c{i}" for i in range(len(names)) if i != t]
    changed = joined.where("spans is not null").select(*rest, text.alias("text"), "spans")
    kinds = {f.name: f.dataType.simpleString() for f in side.schema.fields}
    cleaned = changed.mapInArrow(_remove, ", ".join([f"{c} {kinds[c]}" for c in rest] + ["text string"])).where(r"text rlike '\\S'")
    if length_col in names:
        n = f"c{names.index(length_col)}"
        cleaned = cleaned.withColumn(n, F.length("text").cast(kinds[n]))
    plain = joined.where("spans is null").select(*rest, text.alias("text"))
    out = plain.unionByName(cleaned)
    return out.select(*[F.col("text" if i == t else f"c{i}").alias(n) for i, n in enumerate(names)])
