"""Exact row numbers without sorting a whole group in one task.

Rows are cut into ranges of their sort key. The rows of each are counted, a running sum gives each range its
offset, and rows are numbered inside their range only. For all rows of a table, the ranges are those that Spark's
sampler draws; for the first rows of each key, they are prefixes of a hash, counted before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Bin tables proven to have no more rows than this (about 50 MB) are broadcast.
MAX_BROADCAST_BINS = 1_000_000


def _running(sizes: DataFrame, keys: Sequence[str], bin_col: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select(
        *keys, bin_col,
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"),
        F.sum("_n").over(w).alias("_total"),
    )


def bin_offsets(df: DataFrame, keys: Sequence[str], bin_col: str, coarse: Column | None = None) -> DataFrame:
    """``keys, bin, _before, _total``: rows of the key in earlier bins, rows of the key.

    ``coarse`` (monotone in the bin) splits the running sum in two levels where a key may have
    very many bins.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("_n"))
    if coarse is None:
        return _running(sizes, keys, bin_col)
    sizes = sizes.withColumn("_coarse", coarse)
    blocks = _running(
        sizes.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n")), keys, "_coarse"
    )
    inner = _running(sizes, [*keys, "_coarse"], bin_col).select(
        *keys, "_coarse", bin_col, F.col("_before").alias("_inner")
    )
    return inner.join(blocks, [*keys, "_coarse"]).select(
        *keys, bin_col, (F.col("_before") + F.col("_inner")).alias("_before"), "_total"
    )


def number_rows(df: DataFrame, order_by: str, partitions: int | None = None) -> DataFrame:
    """Adds ``row_number`` (from 0) and ``_total`` in the order of a unique column, nulls first.

    Rows are dealt over ranges of the column that Spark's sampler draws, sorted inside their range and
    stored with their place in it, when this is called: the sampler may draw other ranges next time. Then the rows of each range are
    counted, and every row adds the number of rows in the ranges before its own. Rows shuffle once.
    """
    ranged = df.repartitionByRange(partitions, order_by) if partitions else df.repartitionByRange(order_by)
    placed = ranged.sortWithinPartitions(order_by).withColumn("_place", F.monotonically_increasing_id())
    path = scratch_dir(df.sparkSession, "numbered")
    placed.write.parquet(path)
    stored = df.sparkSession.read.schema(placed.schema).parquet(path)
    # the upper bits of a place are the number of the range, the lower 33 count inside it
    part, inside = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    offset = F.get(F.lit(before), part) if before else F.lit(0)
    return stored.select(
        *(F.col(f"`{c}`") for c in df.columns), (offset + inside).alias("row_number"), F.lit(total).cast("bigint").alias("_total")
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order_hex: str, quota: int, key_count: int | None = None,
    prefix: int = 4,
) -> DataFrame:
    """The ``quota`` smallest rows of each key by a hexadecimal hash column, with their rank.

    Bins are hash prefixes, so even a key with a third of all rows has evenly filled ones. Bins
    that start past the quota are dropped by a join. Where the caller knows how many keys there
    are, the bin table has at most ``key_count * 16**prefix`` rows; if that is within
    ``MAX_BROADCAST_BINS`` it is broadcast, and rows past the quota are never shuffled.
    """
    keys = list(keys)
    binned = df.withColumn("_bin", F.left(F.col(order_hex), F.lit(prefix)))
    offsets = bin_offsets(binned, keys, "_bin").where(F.col("_before") < quota)
    if key_count is not None and key_count * 16**prefix <= MAX_BROADCAST_BINS:
        offsets = F.broadcast(offsets)
    inner = Window.partitionBy(*keys, "_bin").orderBy(order_hex)
    return (
        binned.join(offsets, [*keys, "_bin"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inner))
        .where(F.col("rank") <= quota)
        .drop("_bin", "_before", "_total")
    )
