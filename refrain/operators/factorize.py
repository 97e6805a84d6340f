"""Factorizations of tables of texts, what is counted about them, and back to texts.

A row is a text and one unit of work: kernels run inside the JVM, a text at a time, so nothing is shuffled and a
partition is never held whole. What a text gives can stay in its row as an array (packed) or become rows of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec, factors as K
from ..functions.jvm import kernel
from ..functions.suffixes import MAX_TEXTS, Suffixes

FACTORS = "text_id long, phrase_no long, pos long, src long, len long, literal long"
#: Bytes of texts handled at once; a longer text is a batch of its own.
BATCH = 1 << 20


def indexed(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[tuple[np.ndarray, list[bytes], Suffixes]]:
    """Ids, texts and suffix order of batches of (text_id, data) rows of about size bytes."""
    for batch in batches:
        ids, data = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        first = total = 0
        for i, text in enumerate([*data, None]):
            if text is None or (i > first and (total + len(text) > size or i - first == MAX_TEXTS)):
                if i > first:
                    part = data[first:i]
                    yield ids[first:i], part, Suffixes(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64))
                first, total = i, 0
            total += len(text or b"")


def _made(texts: DataFrame, what: str, name: str, source: str = "data", **options) -> DataFrame:
    """(text_id, name): what a kernel makes of each row's source column."""
    return texts.select("text_id", kernel(texts.sparkSession, what, **options)(F.col(source)).alias(name))


def _rows(texts: DataFrame, what: str, source: str = "data", **options) -> DataFrame:
    """A row for each element of what a kernel makes of each text, the text's id in front."""
    return texts.select("text_id", F.inline(kernel(texts.sparkSession, what, **options)(F.col(source))))


def _factor_rows(ids: np.ndarray, f: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = ["text_id", "phrase_no", "pos", "src", "len", "literal"]
    return pa.RecordBatch.from_arrays([pa.array(ids[f["text"]].astype(np.int64)), *[pa.array(f[n].astype(np.int64)) for n in names[1:]]], names)


def factorize(texts: DataFrame, sections: int = 1, min_ref_len: int = 1) -> DataFrame:
    """Greedy exact factors (text_id, phrase_no, pos, src, len, literal); src and literal are -1 where they don't apply.

    sections > 1 cuts factors at as many borders, as factorizing parts side by side does; a match shorter than
    min_ref_len becomes a literal. Empty texts have no rows."""
    return _rows(texts, "factors", sections=sections, least=min_ref_len)


def packed(texts: DataFrame, tau: int | None = None, mode: str = "lpf_opt", fill: str = "greedy") -> DataFrame:
    """(text_id, factors): each text's factors in order as one array, exact, or approximate where tau is given."""
    _checked(mode, fill, tau)
    return _made(texts, "factors", "factors", tau=tau or 0, mode=mode, fill=fill)


def approximate(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt", fill: str = "greedy") -> DataFrame:
    """Factors from phrases between sampled places, in the form of factorize(); tau is the density of the samples."""
    _checked(mode, fill, tau)
    return _rows(texts, "factors", tau=tau, mode=mode, fill=fill)


def _checked(mode: str, fill: str = "greedy", tau: int | None = None) -> None:
    if mode not in K.PHRASES or fill not in ("greedy", "greedy_naive"):
        raise ValueError(f"unknown mode: {mode!r}, {fill!r}")
    if tau is not None and tau < 1:
        raise ValueError("tau is at least 1")


def counts(texts: DataFrame, tau: int | None = None, mode: str = "lpf_opt", fill: str = "greedy") -> DataFrame:
    """(text_id, bytes, factors, literals, encoded_bits) without factor rows leaving the kernel: exact, or approximate
    where tau is given. Empty texts have a row of zeros."""
    _checked(mode, fill, tau)
    return _rows(texts, "counts", tau=tau or 0, mode=mode, fill=fill)


def decode(factors: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(text_id, data) of factors; with the texts' ids given, those without factors are empty."""
    rows = factors.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("phrase_no", "src", "len", "literal"))).alias("factors"))
    out = unpacked(rows)
    if texts is not None:
        out = texts.select("text_id").distinct().join(out, "text_id", "left").select("text_id", F.coalesce("data", F.lit(b"")).alias("data"))
    return out


def unpacked(packed_: DataFrame) -> DataFrame:
    """(text_id, data) of packed factors."""
    return _made(packed_, "decode", "data", "factors")


def _in_order(factors: DataFrame, name: str, made: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """(text_id, name): what is made of each text's (src, len, literal) in order. Factors are gathered by text in the JVM,
    so that Python sees batches of texts instead of a call for each."""
    packed = factors.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("phrase_no", "src", "len", "literal"))).alias("factors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge, rows = batch.column(1).offsets.to_numpy(), batch.column(1).values
            columns = [rows.field(i).to_numpy() for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made(*[c[a:b] for c in columns]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["text_id", name])

    return packed.mapInArrow(run, f"text_id long, {name} binary")


def statistics(factors: DataFrame) -> DataFrame:
    """(text_id, bytes, factors, literals, longest, bytes_per_factor) of each text that has factors."""
    covered = F.greatest("len", F.lit(1))
    out = factors.groupBy("text_id").agg(F.sum(covered).alias("bytes"), F.count("*").alias("factors"), F.sum((F.col("len") == 0).cast("long")).alias("literals"), F.max("len").alias("longest"))
    return out.withColumn("bytes_per_factor", F.col("bytes") / F.col("factors"))


def corpus(statistics_: DataFrame) -> DataFrame:
    """One row: texts, bytes, factors, bytes_per_factor."""
    out = statistics_.agg(F.count("*").alias("texts"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("factors"), F.lit(0)).alias("factors"))
    return out.withColumn("bytes_per_factor", F.col("bytes") / F.nullif(F.col("factors"), F.lit(0)))


def ratio(approximate_: DataFrame, exact_: DataFrame) -> DataFrame:
    """(text_id, approximate, exact, ratio) of two tables of (text_id, factors)."""
    a = approximate_.select("text_id", F.col("factors").alias("approximate"))
    return a.join(exact_.select("text_id", F.col("factors").alias("exact")), "text_id").withColumn("ratio", F.col("approximate") / F.nullif(F.col("exact"), F.lit(0)))


def _per_text(texts: DataFrame, schema: str, rows: Callable[[Suffixes, int, bytes], list[tuple]]) -> DataFrame:
    """Rows of a kernel for each text, its id in front."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, index in indexed(batches):
            out = [(int(i), *r) for k, (i, t) in enumerate(zip(ids, data)) for r in rows(index, k, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kinds[t]) for j, t in enumerate(("long", *types))], ["text_id", *names])

    return texts.select("text_id", "data").mapInArrow(run, f"text_id long, {schema}")


def phrases(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt") -> DataFrame:
    """(text_id, beg, end, src) of the phrases between sampled places."""
    _checked(mode, tau=tau)
    return _rows(texts, "phrases", tau=tau, mode=mode)


def packed_phrases(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt") -> DataFrame:
    """(text_id, phrases): the same as one array for each text."""
    _checked(mode, tau=tau)
    return _made(texts, "phrases", "phrases", tau=tau, mode=mode)


def select_phrases(phrases_: DataFrame) -> DataFrame:
    """Of each text's phrases (text_id, beg, end, src), ones that don't overlap and cover as much."""
    rows = F.struct(*[F.col(c).cast("long").alias(c) for c in ("beg", "end", "src")])
    return select_packed(phrases_.groupBy("text_id").agg(F.sort_array(F.collect_list(rows)).alias("phrases")))


def select_packed(packed_: DataFrame) -> DataFrame:
    """The same of packed phrases."""
    return _rows(packed_, "select", "phrases")


def phrase_statistics(phrases_: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_id, bytes, phrases, covered, gaps, mean_gap, mean_phrase, gap_share) of phrases that don't overlap."""
    from pyspark.sql import Window

    by = Window.partitionBy("text_id").orderBy("beg")
    marked = phrases_.withColumn("gap", (F.col("beg") > F.coalesce(F.lag("end").over(by), F.lit(0))).cast("long"))
    per = marked.groupBy("text_id").agg(F.count("*").alias("phrases"), F.sum(F.col("end") - F.col("beg")).alias("covered"), F.sum("gap").alias("inner_gaps"), F.max("end").alias("last"))
    out = texts.select("text_id", F.octet_length("data").cast("long").alias("bytes")).join(per, "text_id", "left").na.fill(0, ["phrases", "covered", "inner_gaps", "last"])
    return _means(out.withColumn("gaps", F.col("inner_gaps") + (F.col("last") < F.col("bytes")).cast("long")))


def text_statistics(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt") -> DataFrame:
    """phrase_statistics() of each text's own phrases, without phrase rows leaving the kernel."""
    _checked(mode, tau=tau)
    return _means(_rows(texts, "statistics", tau=tau, mode=mode))


def _means(counted: DataFrame) -> DataFrame:
    left, gaps = F.col("bytes") - F.col("covered"), F.col("gaps")
    return counted.select("text_id", "bytes", "phrases", "covered", "gaps", (left / F.nullif(gaps, F.lit(0))).alias("mean_gap"), (F.col("covered") / F.nullif(F.col("phrases"), F.lit(0))).alias("mean_phrase"), (left / F.nullif(F.col("bytes"), F.lit(0))).alias("gap_share"))


def gapped(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt") -> DataFrame:
    """(text_id, step, kind, src, len): gaps (src -1) and copies in turn."""
    _checked(mode, tau=tau)
    return _rows(texts, "gapped", tau=tau, mode=mode)


def encode_stream(texts: DataFrame) -> DataFrame:
    """(text_id, stream): exact factors as an entropy-coded stream."""

    def rows(index: Suffixes, k: int, text: bytes) -> list[tuple]:
        f = K.exact(Suffixes(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
        return [(codec.write_factors(len(text), f["pos"], f["src"], f["len"], f["literal"]),)]

    return _per_text(texts, "stream binary", rows)


def decode_stream(streams: DataFrame) -> DataFrame:
    """(text_id, data) of entropy-coded streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream in batch.column(1).to_pylist():
                f = np.array(list(codec.read_factors(stream)), np.int64).reshape(-1, 4)
                out.append(K.decode(f[:, 1], f[:, 2], f[:, 3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["text_id", "data"])

    return streams.select("text_id", "stream").mapInArrow(run, "text_id long, data binary")


def encode_gapped(texts: DataFrame, tau: int = 32, mode: str = "lpf_opt", min_copy: int = codec.MIN_COPY) -> DataFrame:
    """(text_id, file): the gapped factorization as bytes."""
    _checked(mode, tau=tau)
    return _made(texts, "gapped_file", "file", tau=tau, mode=mode, least=min_copy)


def decode_gapped(files: DataFrame) -> DataFrame:
    """(text_id, data) of gapped files."""
    return _made(files, "read_gapped", "data", "file")


def records(factors: DataFrame, wide: bool = False) -> DataFrame:
    """(text_id, records): each text's factors as records of fixed width."""
    return _in_order(factors, "records", lambda src, length, literal: codec.write_records(src, length, literal, wide))


def from_records(records_: DataFrame, wide: bool = False) -> DataFrame:
    """Factors, in the form of factorize(), of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                src, length, literal = codec.read_records(data, wide)
                pos = np.cumsum(np.maximum(length, 1)) - np.maximum(length, 1)
                yield _factor_rows(np.array([i]), {"text": np.zeros(len(src), np.int64), "phrase_no": np.arange(len(src)), "pos": pos, "src": src, "len": length, "literal": literal})

    return records_.select("text_id", "records").mapInArrow(run, FACTORS)


def compressed_sizes(texts: DataFrame) -> DataFrame:
    """(text_id, bytes, zlib, lzma, bz2, zstd): sizes by general compressors, to hold encodings against."""
    import bz2
    import lzma
    import zlib

    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = (len, lambda t: len(zlib.compress(t, 6)), lambda t: len(lzma.compress(t)), lambda t: len(bz2.compress(t)), lambda t: len(zstandard.compress(t, 4)))
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([way(t) for t in data], pa.int64()) for way in ways]], ["text_id", "bytes", "zlib", "lzma", "bz2", "zstd"])

    return texts.select("text_id", "data").mapInArrow(run, "text_id long, bytes long, zlib long, lzma long, bz2 long, zstd long")
