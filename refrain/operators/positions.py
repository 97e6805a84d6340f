"""Tables with a row for each position of each text: order of suffixes and prefixes, neighbours, longest matches, samples.

Kernels work on batches of texts of bounded size; the relational forms explode positions, which multiplies rows by the
length of texts, and are meant for filtered tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import factors as K
from ..functions.suffixes import Suffixes
from . import strings as S
from .factorize import indexed


def _local(index: Suffixes, place: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, place - index.offs[index.text], -1)


def suffixes(texts: DataFrame, *columns: str) -> DataFrame:
    """(text_id, pos, ...) with columns of choice: rank of the suffix; lpf, the length of the longest match that begins
    earlier, and src, where it first occurs (-1: none); psv, nsv, pgv, nsg: the places nearest in suffix order before and
    after that lie earlier (p.v, n.v with s) or later (g) in the text, -1 where there is none; prefix_rank of the bytes up
    to and with the place, read backwards."""
    known = ("rank", "lpf", "src", "psv", "nsv", "pgv", "ngv", "prefix_rank")
    if set(columns) - set(known):
        raise ValueError(f"columns are of {known}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, index in indexed(batches):
            base = index.offs[index.text]
            at = np.arange(len(index.data))
            out: dict[str, np.ndarray] = {"rank": index.rank - base}
            if {"lpf", "src"} & set(columns):
                longest, previous = index.longest_previous()
                out["lpf"] = longest
                if "src" in columns:
                    out["src"] = _local(index, index.leftmost(previous, longest, longest, previous))
            if {"psv", "nsv"} & set(columns):
                out["psv"], out["nsv"] = (_local(index, x) for x in index.nearest())
            if {"pgv", "ngv"} & set(columns):
                out["pgv"], out["ngv"] = (_local(index, x) for x in index.nearest(greater=True))
            if "prefix_rank" in columns:
                turned = Suffixes(np.frombuffer(b"".join(t[::-1] for t in data), np.uint8), index.offs)
                out["prefix_rank"] = (turned.rank - base)[base + index.end - 1 - at]
            yield pa.RecordBatch.from_arrays([pa.array(ids[index.text].astype(np.int64)), pa.array(at - base), *[pa.array(out[c]) for c in columns]], ["text_id", "pos", *columns])

    return texts.select("text_id", "data").mapInArrow(run, ", ".join(["text_id long", "pos long", *[f"{c} long" for c in columns]]))


def positions(texts: DataFrame, *keep: Column | str) -> DataFrame:
    """(text_id, pos, data) for each place of each text."""
    rows = texts.where(F.octet_length("data") > 0)
    return rows.select("text_id", "data", *keep, F.explode(F.sequence(F.lit(0).cast("long"), S.size(F.col("data")) - 1)).alias("pos"))


def previous_occurrences(texts: DataFrame, k: int) -> DataFrame:
    """(text_id, pos, src): the last earlier place of the k bytes from each place on, null where there is none."""
    rows = positions(texts).where(F.col("pos") + k <= S.size(F.col("data"))).select("text_id", "pos", S.cut(F.col("data"), F.col("pos"), F.lit(k)).alias("kmer"))
    return rows.withColumn("src", F.lag("pos").over(Window.partitionBy("text_id", "kmer").orderBy("pos"))).select("text_id", "pos", "src")


def synchronizing(texts: DataFrame, tau: int, runs: bool = True) -> DataFrame:
    """(text_id, idx, pos) of a string synchronizing set; equal 2 tau bytes are sampled at both places or at neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0).to_numpy(zero_copy_only=False), [K.sync_set(np.frombuffer(t, np.uint8), tau, runs) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            idx = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n).astype(np.int64)), pa.array(idx), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["text_id", "idx", "pos"])

    return texts.select("text_id", "data").mapInArrow(run, "text_id long, idx long, pos long")


def every(texts: DataFrame, rate: int) -> DataFrame:
    """(text_id, idx, pos): every rate-th place."""
    return positions(texts).where(F.col("pos") % rate == 0).select("text_id", (F.col("pos") / rate).cast("long").alias("idx"), "pos")


def delta(statistics: DataFrame, most: int = 256) -> DataFrame:
    """(text_id, delta): the greatest distance of samples, from bytes and factors."""
    return statistics.select("text_id", F.least(F.floor(F.col("bytes") / F.col("factors")), F.lit(most)).cast("long").alias("delta"))


def factor_ends(factors: DataFrame, most: int = 256) -> DataFrame:
    """(text_id, idx, pos): 0, the ends of all factors but the last, and within longer factors every delta-th place."""
    covered = F.greatest("len", F.lit(1))
    per = Window.partitionBy("text_id")
    gap = F.least(F.floor(F.sum(covered).over(per) / F.count("*").over(per)), F.lit(most)).cast("long")
    # the place a factor begins at is the end of the one before; the last factor adds nothing behind its begin
    last = F.col("phrase_no") == F.max("phrase_no").over(per)
    spread = factors.select("text_id", "pos", gap.alias("delta"), F.when(last, F.lit(1)).otherwise(covered).alias("n"))
    at = spread.select("text_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1, F.col("delta"))).alias("pos"))
    return at.withColumn("idx", F.row_number().over(Window.partitionBy("text_id").orderBy("pos")).cast("long") - 1).select("text_id", "idx", "pos")


def sample_at_or_after(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (text_id, pos) with idx, the first sample at or after pos; null where there is none. By a window, not a
    comparison of all pairs."""
    rows = queries.select("text_id", "pos", F.lit(None).cast("long").alias("idx"), F.lit(0).alias("kind")).unionByName(samples.select("text_id", "pos", "idx", F.lit(1).alias("kind")))
    after = Window.partitionBy("text_id").orderBy("pos", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("found", F.first("idx", ignorenulls=True).over(after)).where("kind = 0").select("text_id", "pos", F.col("found").alias("idx"))


def prefix_fingerprints(texts: DataFrame, rate: int = 1) -> DataFrame:
    """(text_id, pos, fp): fingerprint of the first pos bytes, for every rate-th pos from 0 to the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fp = prefix_table(np.frombuffer(text, np.uint8))[::rate]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i)), pa.array(np.arange(len(fp)) * rate), pa.array(fp)], ["text_id", "pos", "fp"])

    return texts.select("text_id", "data").mapInArrow(run, "text_id long, pos long, fp long")


def prefix_table(text: np.ndarray, block: int = 256) -> np.ndarray:
    """Fingerprints of all prefixes: within blocks side by side, then block after block."""
    n = len(text)
    rows = -(-n // block)
    wide = np.zeros((rows, block), np.int64)
    wide.ravel()[:n] = text
    inner = np.zeros((rows, block + 1), np.int64)
    for k in range(block if rows else 0):
        inner[:, k + 1] = (inner[:, k] * K.BASE + wide[:, k]) % K.MODULUS
    powers = np.ones(block + 1, np.int64)
    for k in range(block):
        powers[k + 1] = powers[k] * K.BASE % K.MODULUS
    out = np.zeros(n + 1, np.int64)
    start = 0
    for r in range(rows):
        stop = min(block, n - r * block)
        out[r * block + 1 : r * block + stop + 1] = (start * powers[1 : stop + 1] + inner[r, 1 : stop + 1]) % K.MODULUS
        start = int(out[r * block + stop])
    return out


def rolled(texts: DataFrame, window: int) -> DataFrame:
    """(text_id, pos, fp): fingerprint of the window from each place on, from those of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = pow(K.BASE, window, K.MODULUS)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = prefix_table(np.frombuffer(text, np.uint8))
                fp = (table[window:] - table[:-window] * top) % K.MODULUS if len(table) > window else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int64)), pa.array(np.arange(len(fp))), pa.array(fp)], ["text_id", "pos", "fp"])

    return texts.select("text_id", "data").mapInArrow(run, "text_id long, pos long, fp long")
