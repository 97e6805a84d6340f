"""Byte and bit codes of factors: variable-length bytes, Elias delta, length-limited Huffman, factor streams, gapped files.

Bits are written from the highest of each byte on; the last byte is filled with zeros.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: The longest Huffman code, symbols of a table, factors of a block, and the shortest copy that is kept behind a gap.
MAX_CODE = 15
SYMBOLS = 66
BLOCK = 1 << 14
MIN_COPY = 64


def vbyte(x: int) -> bytes:
    """Seven bits a byte, the lowest first; a set high bit says that more follow."""
    if x < 0:
        raise ValueError("only whole numbers from 0")
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def read_vbyte(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a place, and the place behind it."""
    x = shift = 0
    while True:
        b = data[at]
        at += 1
        x |= (b & 127) << shift
        if b < 128:
            return x, at
        shift += 7


class Bits:
    """Bits written one number after another."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, x: int, n: int) -> None:
        """The lowest n bits of x."""
        if n:
            self.parts.append(format(x & ((1 << n) - 1), f"0{n}b"))

    def delta(self, x: int) -> None:
        """Elias delta code; 0 has none and writes nothing."""
        if x:
            n = x.bit_length()
            self.put(0, n.bit_length() - 1)
            self.put(n, n.bit_length())
            self.put(x, n - 1)

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        self.parts = [text]
        size = -(-len(text) // 8)
        return int(text.ljust(8 * size, "0") or "0", 2).to_bytes(size, "big")


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.text = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else ""
        self.at = 0

    def get(self, n: int) -> int:
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def delta(self) -> int:
        zeros = self.text.index("1", self.at) - self.at
        self.at += zeros
        n = self.get(zeros + 1)
        return 1 << (n - 1) | self.get(n - 1)


def delta_bits(x: int) -> int:
    """Bits of the Elias delta code."""
    return 2 * x.bit_length().bit_length() - 1 + x.bit_length() - 1 if x else 0


def code_lengths(frequency: Iterable[int], most: int = MAX_CODE) -> list[int]:
    """Huffman code lengths of at most most bits; 0 for symbols that don't occur, 1 for one alone.

    Where the tree is deeper, codes are cut to most bits and shorter ones lengthened till all fit; lengths are dealt so
    that rarer symbols have longer codes, of equally frequent ones the lower symbol the longer."""
    weight = list(frequency)
    used = [s for s, f in enumerate(weight) if f]
    out = [0] * len(weight)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more symbols than codes")
    parent: list[int] = [-1] * len(used)
    heap = [(weight[s], k) for k, s in enumerate(used)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        node = len(parent)
        parent.append(-1)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = [0] * len(parent)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    count = [0] * (most + 1)
    for k in range(len(used)):
        count[min(depth[k], most)] += 1
    excess = sum(n << (most - bits) for bits, n in enumerate(count) if bits) - (1 << most)
    while excess > 0:
        bits = max(b for b in range(1, most) if count[b])
        count[bits] -= 1
        count[bits + 1] += 1
        excess -= 1 << (most - bits - 1)
    rare = iter(sorted(used, key=lambda s: weight[s]))
    for bits in range(most, 0, -1):
        for _ in range(count[bits]):
            out[next(rare)] = bits
    return out


def canonical(lengths: list[int]) -> list[int]:
    """Codes of given lengths: counting up within a length, from short to long, in the order of symbols."""
    code, last, out = 0, 0, [0] * len(lengths)
    for bits, s in sorted((b, s) for s, b in enumerate(lengths) if b):
        code <<= bits - last
        out[s], last = code, bits
        code += 1
    return out


def symbols(length: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit widths of lengths (0: literal) and of copies' distances."""
    width = lambda x: np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(int) + 1, 0)
    return width(length), np.where(length > 0, width(distance), -1)


def write_factors(n: int, pos: np.ndarray, src: np.ndarray, length: np.ndarray, literal: np.ndarray) -> bytes:
    """A text's factors: five bytes of its size, then blocks of a count, two tables of code lengths, and codes."""
    out = Bits()
    dist = pos - src
    ls, ds = symbols(length, dist)
    for a in range(0, len(pos), BLOCK):
        b = min(a + BLOCK, len(pos))
        tables = [code_lengths(np.bincount(x[x >= 0], minlength=SYMBOLS)) for x in (ls[a:b], ds[a:b])]
        codes = [canonical(t) for t in tables]
        out.delta(b - a)
        for t in tables:
            for bits in t:
                out.put(bits, 4)
        for s, d, n_, x, c in zip(ls[a:b].tolist(), ds[a:b].tolist(), length[a:b].tolist(), dist[a:b].tolist(), literal[a:b].tolist()):
            out.put(codes[0][s], tables[0][s])
            if s == 0:
                out.put(c, 8)
            else:
                out.put(n_, s - 1)
                out.put(codes[1][d], tables[1][d])
                out.put(x, d - 1)
    return n.to_bytes(5, "little") + out.bytes()


def stream_bits(length: np.ndarray, distance: np.ndarray) -> int:
    """How many bits write_factors spends behind the size, without writing them."""
    total = 0
    ls, ds = symbols(length, distance)
    for a in range(0, len(length), BLOCK):
        s, d = ls[a : a + BLOCK], ds[a : a + BLOCK]
        total += delta_bits(len(s)) + 8 * SYMBOLS + 8 * int((s == 0).sum()) + int(np.maximum(s - 1, 0).sum()) + int(np.maximum(d - 1, 0).sum())
        for x in (s, d):
            f = np.bincount(x[x >= 0], minlength=SYMBOLS)
            total += int(f @ np.array(code_lengths(f)))
    return total


def read_factors(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(pos, src, len, literal) of a stream."""
    n, pos, left = int.from_bytes(data[:5], "little"), 0, 0
    bits = BitReader(data[5:])
    books: list[dict[str, int]] = []

    def symbol(book: dict[str, int]) -> int:
        for k in range(1, MAX_CODE + 1):
            s = book.get(bits.text[bits.at : bits.at + k])
            if s is not None:
                bits.at += k
                return s
        raise ValueError("no such code")

    while pos < n:
        if not left:
            left = bits.delta()
            tables = [[bits.get(4) for _ in range(SYMBOLS)] for _ in range(2)]
            books = [{format(c, f"0{b}b"): s for s, (b, c) in enumerate(zip(t, canonical(t))) if b} for t in tables]
        s = symbol(books[0])
        if s == 0:
            yield pos, -1, 0, bits.get(8)
            pos += 1
        else:
            length = 1 << (s - 1) | bits.get(s - 1)
            d = symbol(books[1])
            yield pos, pos - (1 << (d - 1) | bits.get(d - 1)), length, -1
            pos += length
        left -= 1


def write_gapped(text: bytes, steps: list[tuple[str, int, int]], min_copy: int = MIN_COPY) -> bytes:
    """A gapped factorization: a flag for wide positions, eight bytes of size, then (gap, 0) and its bytes, or (distance,
    length); copies shorter than min_copy behind a gap are part of it."""
    wide = len(text) >= 1 << 32
    out, at, gap = [struct.pack("<?Q", wide, len(text))], 0, 0

    def close() -> None:
        nonlocal gap
        if gap:
            out.append(vbyte(gap) + vbyte(0) + text[at - gap : at])
            gap = 0

    for kind, a, b in steps:
        if kind == "gap":
            gap, at = gap + a, at + a
        elif gap and b < min_copy:
            gap, at = gap + b, at + b
        else:
            close()
            out.append(vbyte(at - a) + vbyte(b))
            at += b
    close()
    return b"".join(out)


def read_gapped(data: bytes) -> bytes:
    _, n = struct.unpack_from("<?Q", data)
    out, at = bytearray(), 9
    while len(out) < n:
        a, at = read_vbyte(data, at)
        b, at = read_vbyte(data, at)
        if b == 0:
            out += data[at : at + a]
            at += a
        else:
            period = bytes(out[len(out) - a :])
            out += (period * (b // a + 1))[:b]
    return bytes(out)


def write_records(src: np.ndarray, length: np.ndarray, literal: np.ndarray, wide: bool = False) -> bytes:
    """Factors as records of two little-endian numbers, source (or the literal byte) and length, of four or five bytes."""
    size = 5 if wide else 4
    pair = np.stack((np.where(length > 0, src, literal), length), axis=1).astype("<u8")
    if len(pair) and int(pair.max()) >> (8 * size):
        raise ValueError("a number doesn't fit its record")
    return np.ascontiguousarray(pair).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def read_records(data: bytes, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, len, literal) of records."""
    size = 5 if wide else 4
    raw = np.zeros((len(data) // size, 8), np.uint8)
    raw[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    pair = raw.view("<u8").reshape(-1, 2).astype(np.int64)
    copy = pair[:, 1] > 0
    return np.where(copy, pair[:, 0], -1), pair[:, 1], np.where(copy, -1, pair[:, 0])
