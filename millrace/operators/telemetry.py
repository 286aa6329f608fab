"""Server and GPU telemetry.

Samples are rows ``keys, phase, sample, name, labels, value`` with phase ``start``, ``poll`` or
``end``. All statistics are aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import combine
from .quantiles import exact_quantiles, join_on

# The server metrics a summary reads.
REQUESTS = "vllm:request_success_total"
TOKENS = "vllm:generation_tokens_total"
CACHE = "vllm:kv_cache_usage_perc"
RUNNING = "vllm:num_requests_running"
FIRST_TOKEN = "vllm:time_to_first_token_seconds"
INTER_TOKEN = "vllm:request_time_per_output_token_seconds"


def metric_sums(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A metric summed over its label sets, per sample (A10)."""
    return samples.groupBy(*keys, "phase", "sample", "name").agg(F.sum("value").alias("value"))


def _total(name: str, phase: str) -> Column:
    hit = (F.col("name") == name) & (F.col("phase") == phase)
    return F.coalesce(F.sum(F.when(hit, F.col("value"))), F.lit(0.0))


def counter_rates(
    samples: DataFrame, counters: dict[str, tuple[str, int]], elapsed: float | Column, keys: Sequence[str] = ()
) -> DataFrame:
    """(end - start) / elapsed per counter (A11); ``counters`` maps output to (metric, digits).

    No row for a key without end samples, and none at all when nothing elapsed.
    """
    seconds = F.lit(float(elapsed)) if not isinstance(elapsed, Column) else elapsed
    grouped = samples.groupBy(*keys) if keys else samples.groupBy()
    out = grouped.agg(
        F.count_if(F.col("phase") == "end").alias("_ends"),
        seconds.alias("_sec"),
        *[
            (_total(metric, "end") - _total(metric, "start")).alias(name)
            for name, (metric, _) in counters.items()
        ],
    ).where((F.col("_ends") > 0) & (F.col("_sec") != 0))
    return out.select(
        *keys,
        *[F.round(F.col(n) / F.col("_sec"), digits).alias(n) for n, (_, digits) in counters.items()],
    )


def gauge_stats(samples: DataFrame, gauges: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per key and gauge: average, peak, mean over all polls, number of polls.

    ``avg_value`` takes the polled samples that contain the gauge; without any poll it falls back
    to the start and end snapshots. ``peak_value`` and ``mean_over_polls`` need a poll and count a
    poll without the gauge as 0. Values are not rounded.
    """
    keys = list(keys)
    names = F.array(*[F.lit(g) for g in gauges])
    name, value = F.col("name"), F.col("value")
    # one row per sample, then one per key; both steps combine map-side
    per_sample = samples.groupBy(*keys, "phase", "sample").agg(
        *[F.sum(F.when(name == g, value)).alias(f"g{i}") for i, g in enumerate(gauges)]
    )
    polled = F.col("phase") == "poll"
    grouped = per_sample.groupBy(*keys) if keys else per_sample.groupBy()

    def stats(i):
        v = F.col(f"g{i}")
        polls = F.count_if(polled)
        zero_filled = F.when(polled, F.coalesce(v, F.lit(0.0)))
        return F.struct(
            F.when(polls > 0, F.avg(F.when(polled, v))).otherwise(F.avg(F.when(~polled, v))).alias(
                "avg_value"
            ),
            F.max(zero_filled).alias("peak_value"),
            F.avg(zero_filled).alias("mean_over_polls"),
            polls.alias("polls"),
        )

    wide = grouped.agg(F.array(*[stats(i) for i in range(len(gauges))]).alias("_s"))
    return wide.select(*keys, F.explode(F.arrays_zip(names.alias("name"), F.col("_s").alias("s"))).alias("r")).select(
        *keys, "r.name", "r.s.*"
    )


def histogram_buckets(samples: DataFrame, bases: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Bucket growth between start and end: ``keys, base, labels, le, count``.

    Start and end rows of a label set meet in one aggregate; a set missing at the start started
    from 0, one missing at the end is dropped, and so is the ``+Inf`` bucket.
    """
    base = F.regexp_replace("name", "_bucket$", "")
    rows = samples.where(
        F.col("name").isin([f"{b}_bucket" for b in bases]) & F.col("phase").isin("start", "end")
    )
    end, start = F.col("phase") == "end", F.col("phase") == "start"
    grown = rows.groupBy(*keys, base.alias("base"), "labels").agg(
        F.sum(F.when(end, F.col("value"))).alias("_end"),
        F.coalesce(F.sum(F.when(start, F.col("value"))), F.lit(0.0)).alias("_start"),
    )
    le = F.regexp_extract("labels", r'le="([^"]+)"', 1)
    return (
        grown.where(F.col("_end").isNotNull() & (le != "+Inf"))
        .select(
            *keys, "base", "labels", le.try_cast("double").alias("le"),
            (F.col("_end") - F.col("_start")).alias("count"),
        )
        .where(F.col("le").isNotNull())
    )


def histogram_percentiles(
    samples: DataFrame,
    bases: Sequence[str],
    percentiles: Sequence[float],
    keys: Sequence[str] = (),
    merge_series: bool = False,
) -> DataFrame:
    """Percentiles in ms from cumulative buckets: ``keys, base, pct, value_ms``.

    In the order (le, count) the first bucket that reaches the target is a ``min`` over the buckets
    that do, and the bucket before it (W2) the ``max`` over those that sort lower. Both are
    aggregates, so many label sets under one key never gather in one task. ``merge_series`` adds
    the label sets up per ``le`` first instead of interleaving them.
    """
    keys = list(keys)
    group = [*keys, "base"]
    buckets = histogram_buckets(samples, bases, keys)
    if merge_series:
        buckets = buckets.groupBy(*group, "le").agg(F.sum("count").alias("count"))
    base_of_count = F.regexp_replace("name", "_count$", "")
    ends = F.when(F.col("phase") == "end", F.col("value")).when(
        F.col("phase") == "start", -F.col("value")
    )
    totals = (
        samples.where(F.col("name").isin([f"{b}_count" for b in bases]))
        .groupBy(*keys, base_of_count.alias("base"))
        .agg(F.coalesce(F.sum(ends), F.lit(0.0)).alias("total"))
        .where(F.col("total") != 0)
    )
    targets = totals.select(
        *group,
        F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("pct"),
        "total",
    ).select(*group, "pct", (F.col("pct") / 100.0 * F.col("total")).alias("target"))

    point = F.struct("le", "count")
    first = (
        join_on(buckets, targets, group)
        .groupBy(*group, "pct", "target")
        .agg(
            F.min(F.when(F.col("count") >= F.col("target"), point)).alias("hit"),
            F.max("le").alias("last_le"),
        )
    )
    before = (
        join_on(buckets, first, group)
        .groupBy(*group, "pct", "target", "hit", "last_le")
        .agg(F.max(F.when(point < F.col("hit"), point)).alias("prev"))
    )
    prev_le = F.coalesce("prev.le", F.lit(0.0))
    prev_count = F.coalesce("prev.count", F.lit(0.0))
    le, count = F.col("hit.le"), F.col("hit.count")
    inside = prev_le + (le - prev_le) * (F.col("target") - prev_count) / (count - prev_count)
    seconds = (
        F.when(F.col("hit").isNull(), F.col("last_le"))
        .when(count == prev_count, le)
        .otherwise(inside)
    )
    return before.select(*group, "pct", F.round(seconds * 1000, 1).alias("value_ms"))


def server_summary(samples: DataFrame, elapsed: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """The ten server metrics of a run, one row per key with an end snapshot."""
    keys = list(keys)
    rates = counter_rates(
        samples,
        {
            "vllm_request_throughput_req_per_sec": (REQUESTS, 3),
            "vllm_token_throughput_tok_per_sec": (TOKENS, 1),
        },
        elapsed,
        keys,
    )
    g = gauge_stats(samples, [CACHE, RUNNING], keys)
    cache, running = F.col("name") == CACHE, F.col("name") == RUNNING
    gauges = g.select(
        *keys,
        F.when(cache, F.round(F.col("avg_value") * 100, 4)).alias("vllm_kv_cache_usage_avg_pct"),
        F.when(cache, F.round(F.col("peak_value") * 100, 4)).alias("vllm_kv_cache_peak_pct"),
        F.when(running, F.round("mean_over_polls", 2)).alias("vllm_effective_batch_size_avg"),
        F.col("polls").alias("vllm_scrape_count"),
    )
    h = histogram_percentiles(samples, [FIRST_TOKEN, INTER_TOKEN], [50, 95], keys)
    parts = {("ttft", 50): FIRST_TOKEN, ("ttft", 95): FIRST_TOKEN, ("itl", 50): INTER_TOKEN, ("itl", 95): INTER_TOKEN}
    latencies = h.select(
        *keys,
        *[
            F.when((F.col("base") == base) & (F.col("pct") == p), F.col("value_ms")).alias(
                f"vllm_{short}_p{p}_ms"
            )
            for (short, p), base in parts.items()
        ],
    )
    merged = combine([rates, gauges, latencies], keys)
    return merged.where(F.col("vllm_request_throughput_req_per_sec").isNotNull()).select(
        *keys,
        "vllm_request_throughput_req_per_sec",
        "vllm_token_throughput_tok_per_sec",
        *[f"vllm_{s}_p{p}_ms" for s, p in parts],
        "vllm_kv_cache_usage_avg_pct",
        "vllm_kv_cache_peak_pct",
        "vllm_effective_batch_size_avg",
        "vllm_scrape_count",
    )


def gpu_stats(samples: DataFrame, keys: Sequence[str] = (), value: str = "util") -> DataFrame:
    """GPU utilisation: average, peak, p50, p95, population deviation."""
    keys = list(keys)
    grouped = samples.groupBy(*keys) if keys else samples.groupBy()
    moments = grouped.agg(
        F.round(F.avg(value), 1).alias("gpu_util_avg_pct"),
        F.round(F.max(value), 1).alias("gpu_util_peak_pct"),
        F.round(F.stddev_pop(value), 2).alias("gpu_util_stddev_pct"),
    )
    q = exact_quantiles(samples, value, {"p50": 0.50, "p95": 0.95}, keys).select(
        *keys,
        F.round("p50", 1).alias("gpu_util_p50_pct"),
        F.round("p95", 1).alias("gpu_util_p95_pct"),
    )
    order = ("avg", "peak", "p50", "p95", "stddev")
    return combine([moments, q], keys).select(*keys, *[f"gpu_util_{n}_pct" for n in order])
