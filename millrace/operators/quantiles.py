"""Exact quantiles whose state stays bounded however many rows one key has.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here values are binned by
their exponent and leading 12 mantissa bits, so bins order like values. A first pass counts rows per
bin, combined before the shuffle to a few thousand counts per task and key, and tells which bins
hold the wanted ranks. A second pass counts the rows of those bins by the next 20 mantissa bits, and
a third looks at the values of the parts that are left, which differ in their last 20 bits only. So
no task sees more than one key's bins, or about a million counts, whatever the values are: equal
values are one count, and values that lie close together part at the second level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number of a double's bin, never decreasing in the value: exponent, then leading mantissa bits.
_BIN = """
    CASE WHEN isnan(_v) OR abs(_v) = double('infinity') THEN if(_v < 0, -1, 1) * power(2, 40)
         WHEN _v = 0 THEN 0
         ELSE if(_v < 0, -1, 1) * ((floor(log2(abs(_v))) + 1100) * power(2, 14)
              + floor(abs(_v) / power(2.0D, floor(log2(abs(_v)))) * power(2, 12)))
    END"""

# The 20 mantissa bits behind those of the bin, in the order of the values.
_PART = """
    CASE WHEN isnan(_v) OR abs(_v) = double('infinity') OR _v = 0 THEN 0
         ELSE if(_v < 0, -1, 1) * floor(pmod(
              abs(_v) / power(2.0D, floor(log2(abs(_v)))) * power(2, 12), 1.0D) * power(2, 20))
    END"""

#: The wanted bins are broadcast when the number of keys proves that there are no more than this.
MAX_BROADCAST_BINS = 1_000_000


def _positions(probs: Sequence[float]) -> Column:
    """Ranks, from 0, that the quantiles of ``_total`` rows lie between."""
    low = [f"floor((_total - 1) * {float(p)!r}D)" for p in probs]
    ranks = ", ".join(f"{rank}, least({rank} + 1, _total - 1)" for rank in low)
    return F.expr(f"array_distinct(array({ranks}))")


def join_on(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in columns})
    cond = F.lit(True)
    for i, c in enumerate(columns):
        equal = F.col(c).eqNullSafe(F.col(f"_right_{c}"))
        cond = equal if i == 0 else cond & equal
    return left.join(renamed, cond, how).drop(*[f"_right_{c}" for c in columns])


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (),
    max_keys: int | None = None,
) -> DataFrame:
    """One row per key: its columns, ``n`` and one column per entry of ``probs``.

    Linear interpolation at rank ``(n - 1) * p``, as ``percentile`` does; NULL values are ignored
    and keys without values are absent. With a known bound on the number of keys the second pass
    filters its rows by a broadcast table of wanted bins (two per quantile and key) and shuffles
    only what is left; otherwise the planner chooses the join.
    """
    keys = list(keys)
    if not keys:
        max_keys = 1
    bounded = max_keys is not None and max_keys * 2 * len(probs) <= MAX_BROADCAST_BINS
    rows = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
        .withColumn("_bin", F.expr(_BIN).cast("bigint"))
        .withColumn("_part", F.expr(_PART).cast("bigint"))
    )
    # what a join would move is counted by value first
    again = rows if bounded else rows.groupBy(*keys, "_bin", "_part", "_v").agg(F.sum("_c").alias("_c"))

    def running(partition, order):
        w = Window.partitionBy(*partition).orderBy(order)
        return F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def holding(counts, within, step, ranks):
        """The steps that hold a rank, with the number of rows before each and the ranks in it."""
        before = F.col("_before") + running(within, step) - F.col("_n")
        held = F.filter(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_n")))
        placed = counts.withColumn("_from", before).withColumn("_held", held)
        return placed.where(F.size("_held") > 0).select(
            *within, step, "_total", F.col("_from").alias("_before"), F.col("_held").alias("_ranks")
        )

    def inside(wanted, columns, step):
        counts = join_on(again, F.broadcast(wanted) if bounded else wanted, columns)
        return counts.groupBy(*columns, "_total", "_before", "_ranks", step).agg(F.sum("_c").alias("_n"))

    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_n")).withColumn("_before", F.lit(0).cast("bigint"))
    bins = bins.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = holding(bins, keys, "_bin", _positions(list(probs.values())))
    parts = holding(inside(wanted, [*keys, "_bin"], "_part"), [*keys, "_bin"], "_part", F.col("_ranks"))
    in_part = [*keys, "_bin", "_part"]
    found = holding(inside(parts, in_part, "_v"), in_part, "_v", F.col("_ranks")).select(
        *keys, "_total", "_v", F.explode("_ranks").alias("_rank")
    )
    values = found.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        # at most two entries per wanted quantile
        F.map_from_entries(F.collect_set(F.struct("_rank", "_v"))).alias("_at"),
    )
    out = []
    for name, p in probs.items():
        position = f"((n - 1) * {float(p)!r}D)"
        low = f"floor({position})"
        at_low, at_high = f"element_at(_at, {low})", f"element_at(_at, least({low} + 1, n - 1))"
        between = f"{at_low} + ({at_high} - {at_low}) * ({position} - {low})"
        out.append(F.expr(f"if({position} = {low}, {at_low}, {between})").alias(name))
    return values.select(*keys, "n", *out)


def approximate_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """The one-pass alternative: ranks are off by at most ``n / accuracy``."""
    picked = F.percentile_approx(F.col(value).cast("double"), list(probs.values()), accuracy)
    rows = df.where(F.col(value).isNotNull())
    agg = [F.count(F.lit(1)).alias("n"), picked.alias("_q")]
    grouped = rows.groupBy(*keys).agg(*agg)
    return grouped.where(F.col("n") > 0).select(
        *keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)]
    )
