"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.storage import ready

#: Largest table, in rows of a few numbers, that is broadcast without asking Catalyst.
BROADCAST_ROWS = 2_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on workers, set the checkpoint folder and shorten Arrow batches (see :func:`lodestack.storage.ready`)."""
    return ready(spark)


_kept: dict[tuple, object] = {}


def worker_table(make: Callable[[str], object], path: str) -> object:
    """``make(path)``, kept in this worker process from task to task; only one such table is kept."""
    key = (make, path)
    if key not in _kept:
        # what the operator before left in this process, table or free memory, goes first
        release_tables()
        _kept[key] = make(path)
    return _kept[key]


def release_tables() -> None:
    """Drop what an earlier operator's tasks left in this worker process, and give freed memory back to the system."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    made = f"__{name}"
    while made.lower() in taken:
        made += "_"
    return made


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(spark: SparkSession) -> None:
    """Let the driver forget broadcasts and shuffles of finished jobs now; Spark's cleaner waits for a collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """``rows`` partitioned by ``key``, of which there are about ``groups`` values: few of them in each partition.

    So the number of tasks grows with the groups, and what one task reads does
    not grow with the corpus, whatever spark.sql.shuffle.partitions says.
    """
    return rows.repartition(max(1, min(shuffle_partitions(rows.sparkSession), groups), groups // 4), key)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if its counted ``rows`` are within ``limit``.

    Beyond the limit Spark shuffles both sides as usual.
    """
    return F.broadcast(df) if rows <= limit else df


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ``''``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_slices(batch: pa.RecordBatch, column: str, target_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold about ``target_bytes``; a longer text stands alone."""
    texts = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, size = 0, 0
    for row, length in enumerate(lengths):
        if size and size + length > target_bytes:
            yield start, row
            start, size = row, 0
        size += int(length)
    if start < len(lengths):
        yield start, len(lengths)


def blocks(batches: Iterator[pa.RecordBatch], column: str, target_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in blocks whose texts hold about ``target_bytes``, whatever the size of a batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for low, high in text_slices(batch, column, target_bytes):
            part = batch.slice(low, high - low)
            length = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + length > target_bytes:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += length
    if held:
        yield pa.concat_batches(held)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of ``column`` as one byte array, and each text's offsets in it; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


def segments(text: str, size: int = 1 << 20, marks: str = " ") -> Iterator[str]:
    """Cut a very long text at a space at least every ``size`` characters or so, without losing any."""
    start = 0
    while len(text) - start > size:
        cut = text.find(marks, start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text
