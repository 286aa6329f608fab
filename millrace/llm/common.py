"""Helpers shared by the operators: stored tables, text columns, flat Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_dir

#: Where the stored tables lie that may be deleted again.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later plans start from files any executor sees."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    return stored


def store_counted(df: DataFrame, label: str, *more: Column) -> tuple[DataFrame, list]:
    """``store``, and the number of rows and further aggregates of them, counted by the same job."""
    seen = Observation()
    counted = [F.count(F.lit(1)).alias("_0"), *(c.alias(f"_{i}") for i, c in enumerate(more, 1))]
    stored = store(df.observe(seen, *counted), label)
    return stored, [seen.get[f"_{i}"] for i in range(len(counted))]


def discard(*stored: DataFrame) -> None:
    """Delete what ``store`` wrote for these tables, once no later plan reads them."""
    for df in stored:
        spark, path = df.sparkSession, _paths.pop(df)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array laid end to end, and the n + 1 offsets of its values."""
    large = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if large.null_count:
        large = large.fill_null("")
    _, offsets, data = large.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    if data is None or not len(bounds) or bounds[-1] == bounds[0]:
        return np.empty(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def text_slices(texts: pa.Array, rows: int = 500, size: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Cut a large-string array into (first row, slice) of few rows and, unless one text is longer, few bytes."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1
        end = min(max(end, start + 1), start + rows, len(texts))
        yield start, texts.slice(start, end - start)
        start = end


def string_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A batch's text column as one large-string array without nulls, with buffers of its own.

    The copy matters: Arrow's string kernels read slices that were cast at a wrong place.
    """
    pa.default_memory_pool().release_unused()  # what the batch before has freed
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()).fill_null("")
