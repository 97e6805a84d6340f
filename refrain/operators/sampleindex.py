"""Search for patterns through sampled positions.

The index of a sampling is a row for each sample: its rank by the suffix from it on (sa_rank) and by the bytes up to
and with it, read backwards (pa_rank). Samples whose next bytes (direction "right") or last bytes ("left") equal a
pattern are neighbours in that order, so a pattern's occurrences at samples are an interval of ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import strings as S
from .positions import suffixes


def build(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """(text_id, idx, pos, pa_rank, sa_rank) of samples (text_id, idx, pos)."""
    ranked = samples.join(suffixes(texts, "rank", "prefix_rank"), ["text_id", "pos"])
    number = lambda c: (F.row_number().over(Window.partitionBy("text_id").orderBy(c)) - 1).cast("long")
    return ranked.select("text_id", "idx", "pos", number("prefix_rank").alias("pa_rank"), number("rank").alias("sa_rank"))


def points(index: DataFrame) -> DataFrame:
    """(text_id, x, y, weight): the index as points of the plane, weighed by their number."""
    return index.select("text_id", F.col("pa_rank").alias("x"), F.col("sa_rank").alias("y"), F.col("idx").alias("weight"))


def _slice(direction: str, pos: Column, n: Column) -> Column:
    if direction not in ("left", "right"):
        raise ValueError("direction is left or right")
    return S.cut(F.col("data"), pos if direction == "right" else pos - n + 1, n)


def _fits(direction: str, pos: Column, n: Column) -> Column:
    return (pos + n <= S.size(F.col("data"))) & (pos >= 0) if direction == "right" else (pos - n + 1 >= 0) & (pos < S.size(F.col("data")))


def locate(texts: DataFrame, index: DataFrame, queries: DataFrame, direction: str = "right") -> DataFrame:
    """(query_id, idx, pos) of the samples where the pattern of each query (query_id, text_id, pos, len) stands: the len
    bytes from pos on (right), or up to and with pos (left). By an equality join on the bytes."""
    asked = queries.join(texts, "text_id").where(_fits(direction, F.col("pos"), F.col("len")) & (F.col("len") > 0))
    asked = asked.select("query_id", "text_id", "len", _slice(direction, F.col("pos"), F.col("len")).alias("pattern"))
    lengths = asked.select("text_id", "len").distinct()
    held = index.join(texts, "text_id").join(lengths, "text_id").where(_fits(direction, F.col("pos"), F.col("len")))
    held = held.select("text_id", "len", "idx", "pos", "pa_rank", "sa_rank", _slice(direction, F.col("pos"), F.col("len")).alias("pattern"))
    return asked.join(held, ["text_id", "len", "pattern"]).select("query_id", "idx", "pos", "pa_rank", "sa_rank")


def extend(texts: DataFrame, index: DataFrame, queries: DataFrame, direction: str = "right") -> DataFrame:
    """(query_id, found, first_rank, last_rank, samples): the interval of ranks that hold each query's pattern."""
    rank = "sa_rank" if direction == "right" else "pa_rank"
    found = locate(texts, index, queries, direction).groupBy("query_id").agg(F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"), F.count("*").alias("samples"))
    out = queries.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.col("samples").isNotNull().alias("found"), "first_rank", "last_rank", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))


def intervals(texts: DataFrame, index: DataFrame, lengths: list[int], direction: str = "right") -> DataFrame:
    """(text_id, len, pattern, first_rank, last_rank) of all patterns of some lengths at samples; pattern is in hex."""
    rank = "sa_rank" if direction == "right" else "pa_rank"
    rows = index.join(texts, "text_id").withColumn("len", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths]))).where(_fits(direction, F.col("pos"), F.col("len")))
    return rows.groupBy("text_id", "len", F.hex(_slice(direction, F.col("pos"), F.col("len"))).alias("pattern")).agg(F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"))


def neighbour_lcp(texts: DataFrame, index: DataFrame, direction: str = "right") -> DataFrame:
    """(text_id, rank, idx, lcp): how many bytes each sample shares with the one before it in order; 0 for the first."""
    rank = "sa_rank" if direction == "right" else "pa_rank"
    before = F.lag("pos").over(Window.partitionBy("text_id").orderBy(rank))
    rows = index.withColumn("other", before).join(texts, "text_id")
    lce = S.lce_right if direction == "right" else S.lce_left
    return rows.select("text_id", F.col(rank).alias("rank"), "idx", F.when(F.col("other").isNull(), F.lit(0).cast("long")).otherwise(lce(F.col("data"), F.col("pos"), F.col("other"))).alias("lcp"))


def pattern_lengths(lcp: DataFrame, most: int = 64, shares: int = 5, budget: float = 0.4) -> DataFrame:
    """(text_id, lengths): lengths worth an interval table: 1, 2, quantiles of the neighbours' common lengths from 3 to
    most, and small lengths as long as few patterns (budget, as a share of the samples) are that short."""
    useful = lcp.where(F.col("lcp").between(3, most))
    quantiles = useful.groupBy("text_id").agg(F.percentile_approx("lcp", [k / shares for k in range(1, shares + 1)], 10_000).alias("q"))
    of = Window.partitionBy("text_id")
    cheap = lcp.groupBy("text_id", "lcp").agg(F.count("*").alias("n"))
    upto = cheap.withColumn("below", F.sum("n").over(of.orderBy("lcp"))).withColumn("all", F.sum("n").over(of))
    small = upto.where((F.col("lcp") >= 2) & (F.col("lcp") < most) & (F.col("below") <= F.col("all") * budget)).groupBy("text_id").agg(F.collect_set((F.col("lcp") + 1)).alias("small"))
    out = lcp.select("text_id").distinct().join(quantiles, "text_id", "left").join(small, "text_id", "left")
    none = F.array().cast("array<bigint>")
    return out.select("text_id", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.coalesce("q", none), F.coalesce("small", none)))).alias("lengths"))
