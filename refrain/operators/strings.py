"""Column expressions on bytes: common extensions, comparisons, windows and fingerprints.

They stay in the JVM: an extension is found by doubling steps, each one comparison of slices, and a fingerprint by a
fold over the bytes. Positions count bytes from 0; a position outside the text extends by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.factors import BASE, MODULUS

#: Steps of a search for an extension, longest first: texts of up to 2^31 bytes.
_STEPS = [1 << k for k in range(30, -1, -1)]


def size(data: Column) -> Column:
    return F.octet_length(data).cast("long")


def cut(data: Column, pos: Column, n: Column) -> Column:
    """n bytes from a place on."""
    return F.substring(data, (pos + 1).cast("int"), n.cast("int"))


def lce_right(data: Column, i: Column, j: Column, most: Column | None = None, offset: Column | None = None) -> Column:
    """How many bytes from i on equal those from j on; with offset, of which so many are known to."""
    left = size(data) - F.greatest(i, j)
    limit = F.greatest(F.least(left, most) if most is not None else left, F.lit(0))
    start = (offset if offset is not None else F.lit(0)).cast("long")
    step = lambda acc, s: F.when((acc + s <= limit) & (cut(data, i + acc, s) == cut(data, j + acc, s)), acc + s).otherwise(acc)
    return F.when((i < 0) | (j < 0), F.lit(0).cast("long")).otherwise(F.aggregate(F.array(*[F.lit(s).cast("long") for s in _STEPS]), start, step))


def lce_left(data: Column, i: Column, j: Column, most: Column | None = None, offset: Column | None = None) -> Column:
    """How many bytes up to and with i equal those up to and with j; with offset, of which so many are known to."""
    there = F.least(i, j) + 1
    inside = F.greatest(i, j) < size(data)
    limit = F.greatest(F.least(there, most) if most is not None else there, F.lit(0))
    start = (offset if offset is not None else F.lit(0)).cast("long")
    step = lambda acc, s: F.when((acc + s <= limit) & (cut(data, i - acc - s + 1, s) == cut(data, j - acc - s + 1, s)), acc + s).otherwise(acc)
    return F.when(~inside | (i < 0) | (j < 0), F.lit(0).cast("long")).otherwise(F.aggregate(F.array(*[F.lit(s).cast("long") for s in _STEPS]), start, step))


def suffix_less(data: Column, i: Column, j: Column) -> Column:
    """Whether the suffix from i on comes before that from j on: bytes are unsigned, shorter ones first."""
    return cut(data, i, size(data)) < cut(data, j, size(data))


def prefix_less(data: Column, i: Column, j: Column) -> Column:
    """Whether the bytes up to and with i, read backwards, come before those up to and with j."""
    n = lce_left(data, i, j)
    return F.when(i - n < 0, j - n >= 0).when(j - n < 0, F.lit(False)).otherwise(cut(data, i - n, F.lit(1)) < cut(data, j - n, F.lit(1)))


def window_value(data: Column, pos: Column, width: int) -> Column:
    """Up to seven bytes as a number, the first the highest; null where the text ends before."""
    return F.when((pos >= 0) & (pos + width <= size(data)), F.conv(F.hex(cut(data, pos, F.lit(width))), 16, 10).cast("long"))


def byte(data: Column, pos: Column) -> Column:
    return window_value(data, pos, 1)


def signed(value: Column) -> Column:
    """An unsigned byte as a signed one, -128 to 127."""
    return F.when(value > 127, value - 256).otherwise(value)


def unsigned(value: Column) -> Column:
    return F.pmod(value, F.lit(256))


def push(fingerprint: Column, value: Column) -> Column:
    """The fingerprint of a string with one byte more."""
    return F.pmod(fingerprint * F.lit(BASE) + value, F.lit(MODULUS))


def power(n: Column) -> Column:
    """BASE to the n-th, modulo MODULUS, by squares."""
    squares = [pow(BASE, 1 << k, MODULUS) for k in range(31)]
    bits = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("long").alias("s")) for k, s in enumerate(squares)])
    return F.aggregate(bits, F.lit(1).cast("long"), lambda acc, x: F.when(F.pmod(F.floor(n / F.pow(F.lit(2.0), x["k"])), F.lit(2)) == 1, F.pmod(acc * x["s"], F.lit(MODULUS))).otherwise(acc))


def fingerprint(data: Column, pos: Column, n: Column) -> Column:
    """Fingerprint of n bytes from a place on, by a fold."""
    places = F.when(n > 0, F.sequence(pos, pos + n - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: push(acc, F.conv(F.hex(cut(data, p, F.lit(1))), 16, 10).cast("long")))


def concat(left: Column, right: Column, right_size: Column) -> Column:
    """The fingerprint of two strings end to end."""
    return F.pmod(F.pmod(left * power(right_size), F.lit(MODULUS)) + right, F.lit(MODULUS))


def roll(fp: Column, out: Column, in_: Column, window: int) -> Column:
    """The fingerprint of a window moved on by one byte."""
    return F.pmod(F.pmod(fp * F.lit(BASE) + in_, F.lit(MODULUS)) - F.pmod(out * F.lit(pow(BASE, window, MODULUS)), F.lit(MODULUS)), F.lit(MODULUS))


def between(upto_begin: Column, upto_end: Column, n: Column) -> Column:
    """The fingerprint of n bytes from those of the prefixes before and with them."""
    return F.pmod(upto_end - F.pmod(upto_begin * power(n), F.lit(MODULUS)), F.lit(MODULUS))


def vbyte_size(x: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def bit_width(x: Column) -> Column:
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0).cast("long")


def delta_size(x: Column) -> Column:
    """Bits of the Elias delta code; 0 for 0, which has none."""
    return F.when(x > 0, 2 * bit_width(bit_width(x)) - 1 + bit_width(x) - 1).otherwise(0).cast("long")


def log2_floor(x: Column) -> Column:
    return bit_width(x) - 1


def log2_ceil(x: Column) -> Column:
    return F.when(x > 1, bit_width(x - 1)).otherwise(0).cast("long")


def div_ceil(x: Column, y: Column) -> Column:
    return F.ceil(x / y).cast("long")


def max_sample_length(ratio: Column) -> Column:
    """The longest sampled pattern, from bytes a factor."""
    return F.round(ratio * (1 + 0.5 * F.exp(-ratio / 1000))).cast("long")


def pattern_guess(mean_gap: Column, mean_phrase: Column, gap_share: Column) -> Column:
    return F.least(mean_gap, mean_phrase, 8.0 * F.pow(F.lit(128.0), 1 - gap_share))


def gap_patterns(guess: Column) -> Column:
    """The k-mer lengths that gaps are searched by."""
    from ..functions.factors import PATTERNS

    out = None
    for most, lengths in PATTERNS:
        value = F.array(*[F.lit(x) for x in lengths])
        out = (F.when(guess <= most, value) if out is None else out.when(guess <= most, value)) if most != float("inf") else out.otherwise(value)
    return out
