"""Vectorised byte-level kernels shared by the operators of this subpackage.

Everything works on Arrow string buffers viewed as numpy arrays, a batch of
documents at a time, so no Python statement runs per token or per character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random odd multipliers for the bytes of a span, by position in the span modulo their number.
_POS = (_RNG.integers(0, 2**63, 64, dtype=np.uint64) << _U64(1)) | _U64(1)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offsets of rows in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters that UTF-8 writes as C3 80 to C3 9E."""
    out = _LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def tokens(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't in gap; runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:][offs[1:] > 0] - 1
    last[cut] = inside[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of data[s:e] of each span, none of them empty; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    cuts = np.searchsorted(starts, np.arange(int(starts[0]) + block, int(starts[-1]) + 1, block))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)]):
        if a < b:
            _spans(data, starts[a:b], ends[a:b], out[a:b])
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    lengths = ends - starts
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    at = np.arange(int(lengths.sum()))
    within = at - np.repeat(first, lengths)
    value = _BYTE[data[at + np.repeat(starts - first, lengths)]] * _POS[within & 63]
    if int(lengths.max()) > 64:  # the block number goes into the value: bytes 64 apart must not commute
        far = within >= 64
        value[far] = mix(value[far] + (within[far] >> 6).astype(np.uint64) * _U64(0x9E3779B97F4A7C15))
    out[:] = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def windows(tokens_hash: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every window of size consecutive values; len - size + 1 of them."""
    n = len(tokens_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power, step, width, done, base64 = np.zeros(n, np.uint64), tokens_hash, None, 1, 0, int(base) | 1
    # windows of 1, 2, 4, ... by doubling, put together by the bits of size
    bits = size
    while bits:
        if bits & 1:
            out = out * _U64(pow(base64, width, 1 << 64)) + power[done : done + n]
            done += width
        bits >>= 1
        if bits:
            power = power[: len(power) - width] * _U64(pow(base64, width, 1 << 64)) + power[width:]
            width *= 2
    return mix(out)
