"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are encoded by a public byte-pair vocabulary (a file of ranks, given as a
parameter) and written as rows of (doc_id, n_tokens, tokens), sorted by id within
each file. Readers split a file at its stripes; a filter on doc_id is answered
from the stripes' and row groups' statistics and Bloom filters, without reading
the tokens of row groups that can't hold the id. Writing needs no shuffle.

Defined results: a null text has null tokens and a null count, an empty text an
empty array and 0. Special tokens' strings are ordinary text. Repeated rows are
written as often as they come; null ids are written as null and sort first.
Other columns are never looked at. An empty table gives an empty table that can
be read.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ensure_checkpoint_dir, pieces

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRIPE_BYTES = 64 << 20
#: Rows of a row group: they are wide, so fewer than usual.
INDEX_ROWS = 1000
SCHEMA = "doc_id long, n_tokens int, tokens array<int>"


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            for piece in pieces(batch, 1):
                ids = [None if t is None else np.array(encode(t), np.int32) for t in piece.column(1).to_pylist()]
                null = np.array([i is None for i in ids], bool)
                counts = np.array([0 if i is None else len(i) for i in ids], np.int32)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.append(null, False))
                values = np.concatenate([np.zeros(0, np.int32), *[i for i in ids if i is not None]])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, mask=null), pa.ListArray.from_arrays(offsets, pa.array(values))], ["doc_id", "n_tokens", "tokens"])

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, tokens) for each row of docs, by id within each partition."""
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return rows.sortWithinPartitions("doc_id").mapInArrow(_tokens(ranks), SCHEMA)


def write(tokens: DataFrame, path: str, stripe_bytes: int = STRIPE_BYTES, index_rows: int = INDEX_ROWS, ranges: int = 0) -> None:
    """Writes the table. ranges > 0 shuffles the rows into so many files of ids that don't overlap, so that statistics
    alone prune files; otherwise files are as the input's partitions and Bloom filters prune them. A row group has at
    least 1000 rows, which ORC asks for."""
    if index_rows < 1000:
        raise ValueError("ORC refuses row groups of fewer than 1000 rows")
    if ranges > 0:
        tokens = tokens.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id")
    options = {"orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    tokens.write.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The table, or the rows of the given ids; the filter reaches stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin([int(i) for i in ids]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """docs written as ORC in the shared folder, and read from there."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}.orc"
    write(tokenize(docs, id_col, text_col, ranks), path)
    return read(spark, path)
