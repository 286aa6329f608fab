"""Run metrics (A1-A7) and the metrics report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variants as V
from ..functions.errors import ERROR_CATEGORIES, error_category, failed
from ..functions.text import float_text
from .infer import completion_tokens
from .quantiles import approximate_quantiles, exact_quantiles


def metric_inputs(results: DataFrame) -> DataFrame:
    """Typed metric columns of result rows.

    Latency and retries come from the metadata, where a request's own metadata may have replaced
    them; values of another type do not count.
    """
    meta = F.col("metadata")

    def value(key):
        return F.try_element_at(meta, F.lit(key))

    output = results.schema["output"].dataType.typeName()
    usage = (
        F.col("output.usage")
        if output == "struct"
        else F.try_variant_get("output", "$.usage", "variant")
    )
    retry = value("retry_count")
    whole = F.schema_of_variant(retry).isin("BIGINT", "BOOLEAN")
    return results.select(
        *[c for c in results.columns if c not in ("input", "output", "metadata", "error")],
        "error",
        V.number_or_null(value("request_latency_ms")).alias("latency_ms"),
        F.when(whole, V.number_or_null(retry, "bigint")).alias("retry_count"),
        F.coalesce(completion_tokens(usage), F.lit(0)).alias("tokens"),
    )


def _per_second(amount: Column, elapsed: Column, digits: int) -> Column:
    return F.when(elapsed != 0, F.round(amount / elapsed, digits))


def _pct(part: Column, total: Column, digits: int = 2) -> Column:
    return F.round(part * 100.0 / total, digits)


def combine(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per-key rows of several aggregates side by side, merged by one more aggregate.

    Each part has one row per key at most and its own columns, so ``max`` just picks the value; no
    join is needed, with or without keys.
    """
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    values = [c for c in union.columns if c not in keys]
    aggs = [F.max(c).alias(c) for c in values]
    return union.groupBy(*keys).agg(*aggs) if keys else union.agg(*aggs)


def run_metrics(
    rows: DataFrame, elapsed_sec: float | Column, keys: Sequence[str] = (), exact: bool = True,
    summary: bool = False, max_keys: int | None = None,
) -> DataFrame:
    """One row of run metrics, or one per key; with ``summary`` also the columns of A7.

    ``rows`` has ``error, latency_ms, retry_count, tokens`` (see :func:`metric_inputs`).
    ``elapsed_sec`` is the wall clock of the run, or an aggregate expression giving it per key.
    ``max_keys`` is a known bound on the number of keys, see ``exact_quantiles``.
    Counters take one pass; latency and token quantiles share another.
    """
    keys = list(keys)
    bad = failed(F.col("error"))
    retried = F.col("retry_count") > 0
    elapsed = F.lit(float(elapsed_sec)) if not isinstance(elapsed_sec, Column) else elapsed_sec
    category = F.col("_category")
    staged = rows.withColumn("_category", F.when(bad, error_category(F.col("error"))))
    grouped = staged.groupBy(*keys) if keys else staged.groupBy()
    counters = grouped.agg(
        elapsed.cast("double").alias("elapsed"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~bad).alias("ok"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"),
        F.count_if(retried).alias("retried"),
        F.count_if(retried & ~bad).alias("retried_ok"),
        *[F.count_if(category == c).alias(f"n_{c}") for c in ERROR_CATEGORIES],
        F.coalesce(F.sum(F.when(~bad, F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
    measured = rows.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("latency").alias("kind"), F.col("latency_ms").cast("double").alias("x")),
                F.struct(
                    F.lit("tokens").alias("kind"), F.when(~bad, F.col("tokens").cast("double")).alias("x")
                ),
            )
        ).alias("m"),
    ).select(*keys, "m.kind", "m.x")
    probs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    groups = 1 if not keys else max_keys
    if exact:
        bound = None if groups is None else 2 * groups
        q = exact_quantiles(measured, "x", probs, [*keys, "kind"], bound)
    else:
        q = approximate_quantiles(measured, "x", probs, [*keys, "kind"])
    latency, tokens = F.col("kind") == "latency", F.col("kind") == "tokens"
    q = q.select(
        *keys,
        *[F.when(latency, F.round(p, 2)).alias(f"latency_{p}") for p in ("p50", "p95", "p99")],
        F.when(tokens, F.round("p95", 2)).alias("tokens_p95"),
    )
    c = combine([counters, q], keys)
    total, ok, elapsed = F.col("total"), F.col("ok"), F.col("elapsed")
    some = total > 0
    counts = [
        total.alias("total_requests"),
        ok.alias("successful_requests"),
        (total - ok).alias("failed_requests"),
        F.when(some, F.round(ok * 100 / total, 2)).otherwise(0.0).alias("success_rate_pct"),
    ]
    return c.where(F.col("total").isNotNull()).select(
        *keys,
        *(counts if summary else []),
        F.round(elapsed, 3).alias("elapsed_sec"),
        _per_second(ok, elapsed, 3).alias("successful_req_per_sec"),
        *[F.col(f"latency_{p}").alias(f"request_latency_{p}_ms") for p in ("p50", "p95", "p99")],
        F.col("retries").alias("retry_count_total"),
        F.when(some, _pct(F.col("retried"), total)).otherwise(0.0).alias("retry_rate_pct"),
        F.when(some, F.round(F.col("retries") / total, 3)).otherwise(0.0).alias("avg_retries_per_request"),
        F.when(F.col("retried") > 0, _pct(F.col("retried_ok"), F.col("retried"))).alias(
            "retry_success_rate_pct"
        ),
        F.struct(
            *[
                F.when(some, _pct(F.col(f"n_{k}"), total)).otherwise(0.0).alias(k)
                for k in ERROR_CATEGORIES
            ]
        ).alias("error_rate_by_type_pct"),
        F.when(ok > 0, F.round(F.col("tokens") / ok, 2)).otherwise(0.0).alias("output_tokens_avg"),
        F.coalesce("tokens_p95", F.lit(0.0)).alias("output_tokens_p95"),
        _per_second(F.col("tokens"), elapsed, 1).alias("successful_tok_per_sec"),
    )


def success_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """total, successful and failed requests and the success rate."""
    bad = failed(F.col("error"))
    n = F.count(F.lit(1))
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(
        n.alias("total_requests"),
        F.count_if(~bad).alias("successful_requests"),
        F.count_if(bad).alias("failed_requests"),
        F.when(n > 0, F.round(F.count_if(~bad) * 100 / n, 2)).otherwise(0.0).alias("success_rate_pct"),
    )


def error_rates(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form of A4: one row per category that occurs, with count."""
    return (
        rows.where(failed(F.col("error")))
        .groupBy(*keys, error_category(F.col("error")).alias("category"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )


# Report labels with the metric and the unit they show.
REPORT_LABELS = [
    ("Total requests", "total_requests", ""),
    ("Successful", "successful_requests", ""),
    ("Failed", "failed_requests", ""),
    ("Success rate", "success_rate_pct", "%"),
    ("Total time", "elapsed_sec", "s"),
    ("Successful req/s", "successful_req_per_sec", "req/s"),
    ("Successful tok/s", "successful_tok_per_sec", "tok/s"),
    ("Request latency p50", "request_latency_p50_ms", "ms"),
    ("Request latency p95", "request_latency_p95_ms", "ms"),
    ("Request latency p99", "request_latency_p99_ms", "ms"),
    ("Retry count total", "retry_count_total", ""),
    ("Retry rate", "retry_rate_pct", "%"),
    ("Retries/request avg", "avg_retries_per_request", ""),
    ("Retry success rate", "retry_success_rate_pct", "%"),
    ("Output tokens avg", "output_tokens_avg", ""),
    ("Output tokens p95", "output_tokens_p95", ""),
    ("Request throughput", "vllm_request_throughput_req_per_sec", "req/s"),
    ("Token throughput", "vllm_token_throughput_tok_per_sec", "tok/s"),
    ("p50 TTFT", "vllm_ttft_p50_ms", "ms"),
    ("p95 TTFT", "vllm_ttft_p95_ms", "ms"),
    ("p50 inter-token latency", "vllm_itl_p50_ms", "ms"),
    ("p95 inter-token latency", "vllm_itl_p95_ms", "ms"),
    ("KV cache usage avg", "vllm_kv_cache_usage_avg_pct", "%"),
    ("Effective batch size avg", "vllm_effective_batch_size_avg", ""),
    ("GPU utilization avg", "gpu_util_avg_pct", "%"),
    ("GPU utilization p50", "gpu_util_p50_pct", "%"),
    ("GPU utilization p95", "gpu_util_p95_pct", "%"),
    ("GPU utilization stddev", "gpu_util_stddev_pct", "%"),
    ("GPU utilization peak", "gpu_util_peak_pct", "%"),
    ("Error rate by type", "error_rate_by_type_pct", ""),
]


def _shown(metrics: DataFrame, key: str) -> Column:
    if key not in metrics.columns:
        return F.lit(None).cast("string")
    dtype = metrics.schema[key].dataType
    if isinstance(dtype, T.StructType):
        members = [
            F.concat(F.lit(f"'{f.name}': "), float_text(F.col(f"{key}.{f.name}"))) for f in dtype.fields
        ]
        return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    return float_text(F.col(key)) if isinstance(dtype, T.DoubleType) else F.col(key).cast("string")


def metrics_report(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics rows as report rows ``keys, position, label, value, unit``.

    The thirty labels are constants of the plan: each metrics row explodes into its report rows, so
    nothing is shuffled. A missing metric shows as ``N/A`` without a unit.
    """
    lines = []
    for i, (label, key, unit) in enumerate(REPORT_LABELS):
        shown = _shown(metrics, key)
        lines.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("label"),
                F.coalesce(shown, F.lit("N/A")).alias("value"),
                F.when(shown.isNotNull(), unit).otherwise("").alias("unit"),
            )
        )
    return metrics.select(*keys, F.explode(F.array(*lines)).alias("r")).select(*keys, "r.*")


def envelope_metrics(results: DataFrame, maps: DataFrame) -> DataFrame:
    """Metrics of stored run files: ``source_file, metrics``, a map of texts.

    ``results`` and ``maps`` come from ``sources.results.read_run_file``. The success counts are laid
    under the file's run, server and GPU metrics; later maps win. A file without results counts 0.
    """
    counts = success_summary(metric_inputs(results), ["source_file"])
    names = ("total_requests", "successful_requests", "failed_requests")
    joined = maps.join(counts, "source_file", "left")
    base = F.create_map(
        *[x for n in names for x in (F.lit(n), F.coalesce(n, F.lit(0)).cast("string"))],
        F.lit("success_rate_pct"), float_text(F.coalesce("success_rate_pct", F.lit(0.0))),
    )
    merged = F.map_concat(base, "run_metrics", "vllm_metrics", "gpu_metrics")
    return joined.select("source_file", merged.alias("metrics"))


def metrics_of_map(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Map members as columns, one per reported metric, ready for :func:`metrics_report`."""
    kept = [c for c in rows.columns if c != metrics]
    keys = [key for _, key, _ in REPORT_LABELS]
    return rows.select(*kept, *[F.try_element_at(metrics, F.lit(k)).alias(k) for k in keys])
