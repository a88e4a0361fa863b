"""Helpers that several corpus operators share: cutting lineage, numbering rows, batching texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import checkpoint

__all__ = ["checkpoint", "frugal", "number_rows", "read", "slices", "texts_of"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def number_rows(df: DataFrame, group: str, order: Sequence[Column], name: str, spread: Column, per_bucket: Column, few: bool = True) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each value of ``group``, whatever the size of the largest group.

    A group is dealt into ceil(size / per_bucket) buckets by ``spread`` (a hash of the row). Buckets are counted, their
    running totals become offsets, and only the rows of one bucket meet in a task. ``df`` needs a column ``_size`` with the
    size of the row's group. There are at most (groups + rows / per_bucket) buckets, whose offsets are
    sent to all executors if groups are ``few``.
    """
    dealt = df.withColumn("_bucket", F.pmod(spread, F.greatest(F.ceil(F.col("_size") / per_bucket), F.lit(1))))
    counts = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(within) - 1)
    return (
        numbered.join(F.broadcast(offsets) if few else offsets, [group, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_offset", "_size")
    )


def slices(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each, so that array work on a batch stays small. A longer text
    is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a column of texts with about ``limit`` bytes each, as ``slices`` gives them, and their texts (null: empty), of
    which only one range at a time is in Python's memory."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > limit:
            yield start, i, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if start < len(column):
        yield start, len(column), [t or "" for t in column.slice(start).to_pylist()]


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system when a task ends: its Python worker stays for other tasks, and an idle one
    would keep what the allocators hold."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
        if trim:
            trim(0)

    return wrapped
