"""Shared helpers: tables, scratch files in the shared folder, word numbering inside tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.session import shared_folder

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table once to the shared folder and read it back, which cuts its lineage.

    ``batch_rows`` bounds the rows that Python steps of this table get at a time, for wide rows.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows:
        spark.conf.set(BATCH_ROWS, str(min(batch_rows, int(before))))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def releasing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A Python step that gives its memory back when a task ends; Spark keeps idle workers beside the busy ones."""
    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def releasing_groups(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a step that handles one group after the other."""
    @functools.wraps(function)
    def run(table: pa.Table) -> pa.Table:
        out = function(table)
        give_back()
        return out

    return run


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b if b is not None else b"" for b in pc.cast(column, pa.binary()).to_pylist()]


class WordNumbers(dict):
    """Words numbered from 0 in the order in which a task meets them."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def words(self) -> list[bytes]:
        return list(self)


def number_words(texts: Iterable[bytes], numbers: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in a row, and how many each text has.

    ``bytes.split()`` splits at exactly the six ASCII white-space characters.
    """
    parts, sizes = [], []
    look = numbers.__getitem__
    for text in texts:
        words = text.split()
        sizes.append(len(words))
        parts.append(np.fromiter(map(look, words), np.int64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(sizes, np.int64)


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts with A-Z lower-cased, the number of each word in a row, and how many each text has.

    Arrow splits at the six ASCII white-space characters; a null text is empty.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, lengths = parts.flatten(), parts.value_lengths().to_numpy()
    filled = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty part
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[filled], minlength=len(lengths))
    numbered = flat.dictionary_encode()
    return numbered.dictionary.cast(pa.binary()), numbered.indices.to_numpy().astype(np.int64), lengths.astype(np.int64)


def slices(weights: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Consecutive index ranges whose weights sum to about ``most``; one long row is a range of its own."""
    start = total = end = 0
    for end, weight in enumerate(weights, 1):
        total += weight
        if total >= most:
            yield start, end
            start, total = end, 0
    if end > start:
        yield start, end


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
