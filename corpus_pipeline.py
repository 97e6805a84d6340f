"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage reads the rows that the stage before kept, from Parquet. The two
classifiers are trained on the labelled rows of the whole documents table, so a
document gets the verdict that op8 and op4 give it. The last stage's rows are
places of document pieces in bins, as in op9. No row is left out but those that
a stage rejects; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import packing, quality, simhash, substring, toxicity
from refrain.llm.common import ensure_checkpoint_dir, read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("op8_quality_classifier", good),
    ("op4_toxicity", clean),
    ("op6_simhash_near_dedup", single),
    ("op10_substring_dedup", unrepeated),
    ("op9_best_fit_packing", packed),
]
#: Trained models and fingerprints have no SQL; the tests hold the pipeline against its stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read from there."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}.parquet"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
