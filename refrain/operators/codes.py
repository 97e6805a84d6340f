"""Statistics behind the factor codes: histograms of bit widths by block, and the code lengths made of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from . import strings as S


def symbol_histogram(factors: DataFrame, block: int = codec.BLOCK) -> DataFrame:
    """(kind, block, width, n): how often each bit width of lengths (0: literal) and of copies' distances comes in each
    block of factors, over all texts."""
    kinds = F.array(
        F.struct(F.lit("length").alias("kind"), S.bit_width(F.col("len")).alias("width")),
        F.struct(F.lit("distance").alias("kind"), F.when(F.col("len") > 0, S.bit_width(F.col("pos") - F.col("src"))).alias("width")),
    )
    rows = factors.select(F.floor(F.col("phrase_no") / block).alias("block"), F.explode(kinds).alias("s")).select("s.kind", "block", "s.width")
    return rows.where("width is not null").groupBy("kind", "block", "width").agg(F.count("*").alias("n"))


def code_lengths(histogram: DataFrame) -> DataFrame:
    """(kind, block, width, n, bits): the length of each symbol's code."""

    def run(table: pa.Table) -> pa.Table:
        width, n = table["width"].to_pylist(), table["n"].to_pylist()
        frequency = [0] * codec.SYMBOLS
        for w, k in zip(width, n):
            frequency[w] += k
        bits = codec.code_lengths(frequency)
        return table.select(["kind", "block", "width", "n"]).append_column("bits", pa.array([bits[w] for w in width], pa.int64()))

    return histogram.groupBy("kind", "block").applyInArrow(run, "kind string, block long, width long, n long, bits long")
