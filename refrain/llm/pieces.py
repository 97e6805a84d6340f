"""SentencePiece encoding with spans in the original text, and decoding.

Normalisation is reproduced with its alignment: at each place the longest
prefix that the model's compiled character map knows is replaced, other
characters stand for themselves, spaces become the space mark and a mark is put
in front, as the model says; every byte of the normalised text remembers the
byte of the original where its source began. Pieces come from the library; as
they tile the normalised text, their lengths give their places in it, and the
alignment projects them to byte spans of the original. Bytes of a character
that falls back to bytes share its source: all but the last have empty spans at
its start. Decoding puts the bytes of the pieces together.

The model's file is a parameter; each worker loads it once.

Defined results: a null text has null arrays and a null round trip, an empty
one empty arrays. ``roundtrip`` says whether decoding gives the normalised text
back byte for byte (without a map, the text itself). Rows are handled one by one and whole: very long texts aren't cut,
repeated rows get equal results, ids may be null, other columns are never
looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import bytekit as B
from .common import col
from .common import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_MARK = SPACE.encode()
_SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, roundtrip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class CharMap:
    """A compiled character map, walked where it lies: a double-array trie of prefixes, and what stands for each."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64) if size else np.zeros(0, np.int64)
        self.strings = blob[4 + size :]
        self.by: dict[int, bytes] = {}
        if not size:
            return
        # where the trie goes from each byte, whether a prefix ends there, and which pairs of bytes it knows
        one, self.leaf = self._step(np.full(256, self._next(np.zeros(1, np.int64))[0]), np.arange(256))
        self.pair = np.zeros(1 << 16, bool)
        first = np.flatnonzero(one >= 0)
        two, _ = self._step(np.repeat(one[first], 256), np.tile(np.arange(256), len(first)))
        self.pair[np.repeat(first, 256)[two >= 0] << 8 | np.tile(np.arange(256), len(first))[two >= 0]] = True
        self.one = one

    def _next(self, node: np.ndarray) -> np.ndarray:
        u = self.units[node]
        return node ^ ((u >> 10) << ((u & (1 << 9)) >> 6))

    def _step(self, at: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From places in the trie by a byte each: the next places, -1 where there are none, and whether a prefix ends there."""
        node = at ^ byte
        inside = node < len(self.units)
        node = np.where(inside, node, 0)
        u = self.units[node]
        ok = inside & (u & ((1 << 31) | 0xFF) == byte) & (byte > 0)
        return np.where(ok, self._next(node), -1), ok & ((u >> 8) & 1 == 1)

    def _value(self, at: int) -> bytes:
        value = int(self.units[at] & ((1 << 31) - 1))
        if value not in self.by:
            self.by[value] = self.strings[value : self.strings.index(0, value)]
        return self.by[value]

    def matches(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Begin, end and replacement of the prefixes found from left to right, the longest known one at each place."""
        if not len(self.units) or not len(data):
            z = np.zeros(0, np.int64)
            return z, z, []
        after = np.zeros(len(data), np.int64)
        after[:-1] = data[1:]
        begin = np.flatnonzero((self.leaf[data] | self.pair[(data.astype(np.int64) << 8) | after]) & ((data & 0xC0) != 0x80))
        stop = offs[np.searchsorted(offs, begin, "right")]
        size, value = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        active, place, k = np.arange(len(begin)), np.full(len(begin), self._next(np.zeros(1, np.int64))[0]), 0
        while len(active):
            going = begin[active] + k < stop[active]
            active, place = active[going], place[going]
            place, ends = self._step(place, data[begin[active] + k].astype(np.int64))
            size[active[ends]], value[active[ends]] = k + 1, place[ends]
            active, place, k = active[place >= 0], place[place >= 0], k + 1
        found = np.flatnonzero(size)
        begin, end, value = begin[found], begin[found] + size[found], value[found]
        if (begin[1:] < end[:-1]).any():  # a prefix that begins inside one found before it isn't looked at
            stay, last = np.zeros(len(begin), bool), -1
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                if a >= last:
                    stay[i], last = True, b
            begin, end, value = begin[stay], end[stay], value[stay]
        return begin, end, [self._value(v) for v in value.tolist()]

    def normalised(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts with their prefixes replaced, offsets in them, and of each byte where in data its source begins."""
        head = (data & 0xC0) != 0x80
        source = np.maximum.accumulate(np.where(head, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        begin, end, by = self.matches(data, offs)
        if not len(begin):
            return data, offs, source
        # the bytes before each match, then its replacement
        width = np.array([len(x) for x in by], np.int64)
        taken = np.zeros(len(data) + 1, np.int32)
        taken[begin] += 1
        taken[end] -= 1
        stay = np.flatnonzero(np.cumsum(taken[:-1]) == 0)
        new, at = np.frombuffer(b"".join(by), np.uint8), np.repeat(begin, width)
        where = np.concatenate((stay, at))
        order = np.argsort(where, kind="stable")
        origin = where[order]
        return np.concatenate((data[stay], new))[order], np.searchsorted(origin, offs, "left"), np.concatenate((source[stay], at))[order]


class Pieces:
    """A SentencePiece model with the alignment of its normalisation."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, rule: str | None = None) -> None:
        proto = proto if proto is not None else open(path, "rb").read()
        if rule:
            proto = with_rule(proto, rule)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names, kinds, spec = [], [], {}
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                names.append(piece.get(1, b""))
                kinds.append(piece.get(3, 1))
            elif field == 3:
                spec = dict(_fields(value))
        self.charmap = CharMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.kinds = np.array(kinds)
        texts = [bytes([int(n[3:5], 16)]) if k == 6 else (b"" if k in (3, 5) else n) for n, k in zip(names, kinds)]
        self.size = np.array([len(t) for t in texts], np.int64)
        shown = [t.replace(_MARK, b" ") for t in texts]
        self.shown_size = np.array([len(t) for t in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def align(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of text where the source began."""
        data = np.frombuffer(text.encode(), np.uint8)
        out, source, at, _ = self.align_all(data, np.array([0, len(data)]))
        return out.tobytes(), source

    def align_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The normalised texts end to end; where in its original each byte's source began, with an end for each text;
        the offsets of the texts in that; and the normalised texts as they read, with their offsets."""
        n = len(offs) - 1
        out, at, source = self.charmap.normalised(data, offs)
        row = np.repeat(np.arange(n), np.diff(at))
        stop = offs[1:] - offs[:-1]
        if self.trim:  # one space of a run within a text, none at its ends
            space = out == 32
            first = np.zeros(len(out), bool)
            first[at[:-1][at[:-1] < len(out)]] = True
            before = np.concatenate(([True], space[:-1])) | first
            stay = ~(space & before)
            last = np.zeros(n, np.int64)
            word = np.flatnonzero(~space)
            np.maximum.at(last, row[word], word + 1)
            tail = space & (np.arange(len(out)) >= last[row])
            cut = np.flatnonzero(tail & stay)  # the source of a trailing run begins with its first space
            stop = stop.copy()
            stop[row[cut]] = (source[cut] - offs[row[cut]])
            stay &= ~tail
            out, source, row = out[stay], source[stay], row[stay]
            at = np.searchsorted(row, np.arange(n + 1))
        shown = out, at
        blank = np.diff(at) == 0 if self.trim else np.diff(offs) == 0
        width = np.where(out == 32, 3 if self.escape else 1, 1)
        lead = np.where(blank, 0, (3 if self.escape else 1) * self.prefix)
        source = np.repeat(source - offs[row], width)
        total = np.bincount(row, width, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        begin = np.cumsum(total) - total
        whole = lead + total + 1
        to = np.cumsum(whole) - whole
        place = np.arange(len(source)) + np.repeat(to + lead - begin, total)
        aligned = np.zeros(int(whole.sum()), np.int64)
        aligned[place] = source
        aligned[to + whole - 1] = stop
        if self.trim and self.prefix:  # the mark in front begins where the text's first word does
            some = np.flatnonzero((lead > 0) & (total > 0))
            for k in range(3 if self.escape else 1):
                aligned[to[some] + k] = aligned[to[some] + lead[some]]
        mark = np.frombuffer(_MARK if self.escape else b" ", np.uint8)
        bytes_ = np.zeros(len(aligned), np.uint8)
        wide = np.repeat(out, width)
        if self.escape:
            spaces = np.repeat(out == 32, width)
            wide[spaces] = np.tile(mark, int((out == 32).sum()))
        bytes_[place] = wide
        marked = np.flatnonzero(lead)
        for k in range(len(mark) if self.prefix else 0):
            bytes_[to[marked] + k] = mark[k]
        real = np.ones(len(aligned), bool)
        real[to + whole - 1] = False
        return bytes_[real], aligned, to, shown

    def spans(self, texts: list[str], data: np.ndarray, offs: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end, how many each text has, and the spans."""
        _, source, to, _ = self.align_all(data, offs)
        return self._spans(texts, ids, source, to)

    def _spans(self, texts: list[str], ids: list[list[int]], source: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        counts = np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(counts.sum()))
        size = self.size[flat]
        end = np.cumsum(size)
        first = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        before = np.concatenate(([0], end))[first]
        stop = end - before[row]
        # pieces must tile the normalised text; unknown pieces, which have no length of their own, are asked from the library
        length = np.diff(np.append(to, len(source))) - 1
        tiled = np.bincount(row, size, len(counts)).astype(np.int64) if len(row) else np.zeros(len(counts), np.int64)
        wrong = np.flatnonzero(tiled != length)
        stop = np.minimum(stop, length[row])
        begins = source[to[row] + np.maximum(stop - size, 0)]
        ends = source[to[row] + stop]
        for i in wrong:
            at = slice(int(first[i]), int(first[i] + counts[i]))
            found = self.sp.encode(texts[i], out_type="proto").pieces
            begins[at] = [p.begin for p in found]  # bytes of the text, as ours are
            ends[at] = [p.end for p in found]
        return flat, counts, begins.astype(np.int32), ends.astype(np.int32)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end and their offsets, without the mark in front."""
        size = self.shown_size[flat].copy()
        at = self.shown_at[flat].copy()
        first = (np.cumsum(counts) - counts)[counts > 0]
        if self.prefix and len(first):
            marked = (self.kinds[flat[first]] != 6) & (size[first] > 0)
            marked[marked] = self.shown[at[first[marked]]] == 32
            at[first[marked]] += 1
            size[first[marked]] -= 1
        ends = np.cumsum(size)
        within = np.arange(int(size.sum())) - np.repeat(ends - size, size)
        data = self.shown[np.repeat(at, size) + within]
        offs = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return data, offs


def _field(number: int, kind: int, value: bytes) -> bytes:
    """A field of a serialised protocol buffer; value is its content, without the length."""

    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return varint(number << 3 | kind) + (varint(len(value)) if kind == 2 else b"") + (value if kind == 2 else varint(int.from_bytes(value, "little")))


def with_rule(proto: bytes, rule: str) -> bytes:
    """A model's file with the library's compiled character map of a named rule (such as nfkc) in place of its own."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    compiled = dict(_fields(dict(_fields(made))[3])).get(2, b"")
    out = []
    for number, value in _fields(proto):
        if number == 3:
            spec = {**dict(_fields(value)), 1: rule.encode(), 2: compiled}
            value = b"".join(_field(k, 2 if isinstance(v, bytes) else 0, v if isinstance(v, bytes) else v.to_bytes(8, "little")) for k, v in sorted(spec.items()))
        out.append(_field(number, 2, value) if isinstance(value, bytes) else _field(number, 0, value.to_bytes(8, "little")))
    return b"".join(out)


@functools.cache
def load(path: str, rule: str | None = None) -> Pieces:
    return Pieces(path, rule=rule)


def _lists(values: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def _encode(path: str, rule: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, rule)
        for batch in batches:
            for piece in slices(batch, 1):
                column = piece.column(1)
                null = column.is_null().to_numpy(zero_copy_only=False)
                texts = [t or "" for t in column.to_pylist()]
                data, offs = B.flat(column)
                _, source, to, (data, offs) = model.align_all(data, offs)
                flat, counts, begins, ends = model._spans(texts, model.sp.encode(texts, num_threads=1), source, to)
                back, at = model.decode(flat, counts)
                same = np.diff(at) == np.diff(offs)
                if same.all():
                    differ = np.flatnonzero(back != data)
                    same[np.searchsorted(offs, differ, "right") - 1] = False
                else:
                    raw, out = data.tobytes(), back.tobytes()
                    same = np.array([raw[offs[i] : offs[i + 1]] == out[at[i] : at[i + 1]] for i in range(len(texts))], bool)
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists(flat, counts, null), _lists(begins, counts, null), _lists(ends, counts, null), pa.array(same, mask=null)], ["doc_id", "ids", "begins", "ends", "roundtrip"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, rule: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends, roundtrip) for each row: piece k is bytes [begins[k], ends[k]) of the text. rule puts
    the library's compiled character map of that name (such as nfkc) in place of the model's own."""
    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).mapInArrow(_encode(model, rule), _SCHEMA)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            ids = batch.column(1)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            counts[null] = 0
            data, offs = model.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = data.tobytes()
            texts = [None if null[i] else raw[offs[i] : offs[i + 1]].decode("utf-8", "replace") for i in range(len(null))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    return encoded.select(col(encoded, id_col).cast("long").alias("doc_id"), col(encoded, ids_col).alias("ids")).mapInArrow(_decode(model), "doc_id long, text string")
