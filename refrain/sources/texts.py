"""Where texts come from and go to: tables and raw files as (text_id, data), factor streams, metrics, operation logs.

A text is a row with a binary column; positions count its bytes from 0.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def column(df: DataFrame, name: str) -> Column:
    """df's column of exactly this name."""
    return df["`" + name.replace("`", "``") + "`"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text_id, data) of the rows whose text isn't null; strings are taken as UTF-8."""
    text = column(df, text_col)
    kind = df.schema[text_col].dataType.simpleString()
    return df.select(column(df, id_col).cast("long").alias("text_id"), (text if kind == "binary" else F.encode(text, "UTF-8")).alias("data")).where("data is not null")


def spread(texts_: DataFrame) -> DataFrame:
    """The same rows dealt out over all cores, where the input is too small to give each of them a split of its own (a
    single file of one row group is one task, however long its kernels take). Larger inputs are left as they are: their
    splits suffice, and moving them would cost a shuffle."""
    spark = texts_.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(texts_._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return texts_.repartition(4 * cores) if cores > 1 and size < cores * split else texts_


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text_id, data) of raw files, one row each; text_id is the hash of the path."""
    read = spark.read.format("binaryFile").load(path)
    return read.select("path", F.xxhash64("path").alias("text_id"), F.col("content").alias("data"))


def write_texts(texts_: DataFrame, path: str) -> None:
    texts_.write.parquet(path)


def write_factors(factors: DataFrame, path: str) -> None:
    """Factors as a table, clustered by text and in order within one, so that readers need no sort."""
    factors.repartition("text_id").sortWithinPartitions("text_id", "phrase_no").write.parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics(df: DataFrame, phase: str) -> DataFrame:
    """One row of counts for a phase as (phase, key, value)."""
    row = df.agg(F.count("*").cast("double").alias("rows"), *[F.sum(c).cast("double").alias(f"sum_{c}") for c, t in df.dtypes if t in ("int", "bigint", "double")])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in row.columns])).alias("m")
    return row.select(pairs).select(F.lit(phase).alias("phase"), "m.key", "m.value")


def append_metrics(values: Mapping[str, float], path: str) -> None:
    """Appends a line of JSON for the driver's own log."""
    with open(path, "a") as out:
        out.write(json.dumps(dict(values)) + "\n")


def write_range_log(points: DataFrame, operations: DataFrame, path: str) -> None:
    """Points and the operations on them (op_id, is_insert, weight, x1, x2, y1, y2) as two tables under a path."""
    points.write.parquet(f"{path}/points")
    operations.write.parquet(f"{path}/operations")


def read_range_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/operations")
