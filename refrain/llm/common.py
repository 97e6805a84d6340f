"""Session, naming and batching helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in local mode, as in tests, a folder of our own.

    On a cluster an unset folder is an error: no machine's own folder is readable by the others."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="refrain-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder: a lost executor loses none of it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def col(df: DataFrame, name: str) -> Column:
    """df's column of exactly this name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of the column each, of one row at least: bounds what kernels hold at once."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.concatenate((np.flatnonzero(np.diff(group, prepend=-1)), [n]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def doc_hash(text: Column) -> Column:
    """A 64-bit hash of a text; null has one of its own."""
    return F.when(text.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(text))
