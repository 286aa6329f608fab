"""Run metrics and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions.errors import ERROR_CATEGORIES, error_category
from ..operators import metrics as M
from ..operators import telemetry as TEL
from ..session import scratch_dir
from ..sources import telemetry as TS
from ..streaming import windowed_gauges
from .registry import query

# Error texts of failed events, by the number in their properties.
_ERROR_SQL = """CASE k % 7 WHEN 0 THEN 'Read Timeout after 5' WHEN 1 THEN 'request timed out' WHEN 2 THEN 'HTTP 429'
      WHEN 3 THEN 'Bad Gateway 502' WHEN 4 THEN 'ValueError: bad input' WHEN 5 THEN 'Unsupported URL: /x'
      ELSE 'model mismatch' END"""
_CATEGORY_SQL = """CASE k % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'timeout' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'server'
      WHEN 4 THEN 'validation' WHEN 5 THEN 'validation' ELSE 'other' END"""
_RUN_ROWS = f"""
    (SELECT event_id, event_type, ts, value, k, CASE WHEN user_id % 10 = 0 THEN {_ERROR_SQL} END AS error,
       CASE WHEN user_id % 10 = 0 THEN {_CATEGORY_SQL} END AS category,
       CASE WHEN k % 9 = 0 THEN NULL ELSE value END AS latency_ms, k % 4 AS retry_count, k AS tokens
     FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))
    """


def _error_text():
    k = F.col("k") % 7
    return (
        F.when(k == 0, "Read Timeout after 5").when(k == 1, "request timed out").when(k == 2, "HTTP 429")
        .when(k == 3, "Bad Gateway 502").when(k == 4, "ValueError: bad input")
        .when(k == 5, "Unsupported URL: /x").otherwise("model mismatch")
    )


def run_rows(t):
    """Events as results of five runs, named by event type."""
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.select(
        "event_id", "event_type",
        F.when(F.col("user_id") % 10 == 0, _error_text()).alias("error"),
        F.when(F.col("k") % 9 != 0, F.col("value")).alias("latency_ms"),
        (F.col("k") % 4).alias("retry_count"),
        F.col("k").alias("tokens"),
    )


_ELAPSED = 3600.0
_RUN_METRICS = f"""
      3600.0::DOUBLE AS elapsed_sec,
      round(count(*) FILTER (error IS NULL) / 3600.0::DOUBLE, 3) AS successful_req_per_sec,
      round(quantile_cont(latency_ms, 0.5), 2) AS request_latency_p50_ms,
      round(quantile_cont(latency_ms, 0.95), 2) AS request_latency_p95_ms,
      round(quantile_cont(latency_ms, 0.99), 2) AS request_latency_p99_ms,
      sum(retry_count)::BIGINT AS retry_count_total,
      round(count(*) FILTER (retry_count > 0) * 100.0::DOUBLE / count(*), 2) AS retry_rate_pct,
      round(sum(retry_count)::DOUBLE / count(*), 3) AS avg_retries_per_request,
      round(count(*) FILTER (retry_count > 0 AND error IS NULL) * 100.0::DOUBLE / count(*) FILTER (retry_count > 0), 2)
        AS retry_success_rate_pct,
      {", ".join(f"round(count(*) FILTER (category = '{c}') * 100.0::DOUBLE / count(*), 2) AS error_{c}_pct" for c in ERROR_CATEGORIES)},
      round(avg(tokens) FILTER (error IS NULL), 2) AS output_tokens_avg,
      round(quantile_cont(tokens::DOUBLE, 0.95) FILTER (error IS NULL), 2) AS output_tokens_p95,
      round(sum(tokens) FILTER (error IS NULL) / 3600.0::DOUBLE, 1) AS successful_tok_per_sec
    """


def _flat(metrics):
    rates = [F.col(f"error_rate_by_type_pct.{c}").alias(f"error_{c}_pct") for c in ERROR_CATEGORIES]
    kept = [c for c in metrics.columns if c != "error_rate_by_type_pct"]
    return metrics.select(*kept, *rates)


@query("run_metrics", f"SELECT {_RUN_METRICS} FROM {_RUN_ROWS}")
def run_metrics(t):
    return _flat(M.run_metrics(run_rows(t), _ELAPSED))


@query(
    "run_metrics_by_run",
    f"SELECT event_type, {_RUN_METRICS} FROM {_RUN_ROWS} GROUP BY event_type",
)
def run_metrics_by_run(t):
    return _flat(M.run_metrics(run_rows(t), _ELAPSED, ["event_type"]))


@query(
    "success_summary",
    f"""
    SELECT event_type, count(*) AS total_requests, count(*) FILTER (error IS NULL) AS successful_requests,
      count(*) FILTER (error IS NOT NULL) AS failed_requests,
      round(count(*) FILTER (error IS NULL) * 100::DOUBLE / count(*), 2) AS success_rate_pct
    FROM {_RUN_ROWS} GROUP BY event_type
    """,
)
def success_summary(t):
    return M.success_summary(run_rows(t), ["event_type"])


def _report_sql() -> str:
    shown = {
        "total_requests", "successful_requests", "failed_requests", "success_rate_pct", "elapsed_sec",
        "successful_req_per_sec", "successful_tok_per_sec", "request_latency_p50_ms",
        "request_latency_p95_ms", "request_latency_p99_ms", "retry_count_total", "retry_rate_pct",
        "avg_retries_per_request", "retry_success_rate_pct", "output_tokens_avg", "output_tokens_p95",
    }
    lines = []
    for i, (label, key, unit) in enumerate(M.REPORT_LABELS):
        if key in shown:
            value, unit_sql = f"{key}::VARCHAR", f"'{unit}'"
        elif key == "error_rate_by_type_pct":
            members = " || ', ' || ".join(f"'''{c}'': ' || error_{c}_pct" for c in ERROR_CATEGORIES)
            value, unit_sql = f"'{{' || {members} || '}}'", "''"
        else:
            value, unit_sql = "'N/A'", "''"
        lines.append(
            f"SELECT event_type, {i} AS position, '{label}' AS label, {value} AS value, {unit_sql} AS unit FROM m"
        )
    return f"""
    WITH m AS (SELECT event_type, count(*) AS total_requests, count(*) FILTER (error IS NULL) AS successful_requests,
        count(*) FILTER (error IS NOT NULL) AS failed_requests,
        round(count(*) FILTER (error IS NULL) * 100::DOUBLE / count(*), 2) AS success_rate_pct, {_RUN_METRICS}
      FROM {_RUN_ROWS} GROUP BY event_type)
    {" UNION ALL ".join(lines)}
    """


@query("metrics_report", _report_sql())
def metrics_report(t):
    """The thirty report rows of each run."""
    keys = ["event_type"]
    return M.metrics_report(M.run_metrics(run_rows(t), _ELAPSED, keys, summary=True), keys)


@query(
    "error_category",
    f"SELECT event_id, {_CATEGORY_SQL} AS category FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)",
)
def error_categories(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.select("event_id", error_category(_error_text()).alias("category"))


@query(
    "error_rates",
    f"""
    SELECT event_type, category, count(*) AS errors FROM {_RUN_ROWS}
    WHERE error IS NOT NULL GROUP BY ALL
    """,
)
def error_rates(t):
    return M.error_rates(run_rows(t), ["event_type"])


# Telemetry: each event type is a run, each hour a sample, each user group a label set. The first
# day is the start snapshot, the last day the end snapshot, everything between was polled.
_PHASE = """CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'start' WHEN ts >= TIMESTAMP '2024-01-30' THEN 'end' ELSE 'poll' END"""
_PHASE_SAMPLES = f"""
    (SELECT event_type AS run, {_PHASE} AS phase,
       CASE WHEN {_PHASE} = 'poll' THEN strftime(ts, '%Y-%m-%d %H') ELSE {_PHASE} END AS sample,
       CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'cache' ELSE 'running' END AS name,
       'group="' || user_id % 4 || '"' AS labels, value FROM events)
    """


def phase_samples(t):
    phase = F.when(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz"), "start").when(
        F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"), "end"
    ).otherwise("poll")
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_type").alias("run"),
        phase.alias("phase"),
        F.when(phase == "poll", F.date_format("ts", "yyyy-MM-dd HH")).otherwise(phase).alias("sample"),
        F.when(k % 2 == 0, "cache").otherwise("running").alias("name"),
        F.concat(F.lit('group="'), (F.col("user_id") % 4).cast("string"), F.lit('"')).alias("labels"),
        "value",
    )


@query(
    "metric_sums",
    f"SELECT run, phase, sample, name, round(sum(value), 6) AS value FROM {_PHASE_SAMPLES} GROUP BY ALL",
)
def metric_sums(t):
    sums = TEL.metric_sums(phase_samples(t), ["run"])
    return sums.withColumn("value", F.round("value", 6))


@query(
    "counter_rates",
    f"""
    SELECT run, round((coalesce(sum(value) FILTER (phase = 'end' AND name = 'cache'), 0)
        - coalesce(sum(value) FILTER (phase = 'start' AND name = 'cache'), 0)) / 7200::DOUBLE, 3) AS cache_per_sec,
      round((coalesce(sum(value) FILTER (phase = 'end' AND name = 'running'), 0)
        - coalesce(sum(value) FILTER (phase = 'start' AND name = 'running'), 0)) / 7200::DOUBLE, 1) AS running_per_sec
    FROM {_PHASE_SAMPLES} GROUP BY run HAVING count(*) FILTER (phase = 'end') > 0
    """,
)
def counter_rates(t):
    counters = {"cache_per_sec": ("cache", 3), "running_per_sec": ("running", 1)}
    return TEL.counter_rates(phase_samples(t), counters, 7200.0, ["run"])


@query(
    "gauge_stats",
    f"""
    WITH s AS (SELECT run, phase, sample, sum(value) FILTER (name = 'cache') AS cache,
        sum(value) FILTER (name = 'running') AS running FROM {_PHASE_SAMPLES} GROUP BY ALL),
    l AS (SELECT run, phase, 'cache' AS name, cache AS v FROM s UNION ALL SELECT run, phase, 'running', running FROM s)
    SELECT run, name, round(avg(v) FILTER (phase = 'poll'), 9) AS avg_value,
      round(max(coalesce(v, 0)) FILTER (phase = 'poll'), 9) AS peak_value,
      round(avg(coalesce(v, 0)) FILTER (phase = 'poll'), 9) AS mean_over_polls,
      count(*) FILTER (phase = 'poll') AS polls
    FROM l GROUP BY run, name
    """,
)
def gauge_stats(t):
    out = TEL.gauge_stats(phase_samples(t), ["cache", "running"], ["run"])
    rounded = [F.round(c, 9).alias(c) for c in ("avg_value", "peak_value", "mean_over_polls")]
    return out.select("run", "name", *rounded, "polls")


@query(
    "gpu_stats",
    """
    SELECT event_type, round(avg(value), 1) AS gpu_util_avg_pct, round(max(value), 1) AS gpu_util_peak_pct,
      round(quantile_cont(value, 0.5), 1) AS gpu_util_p50_pct, round(quantile_cont(value, 0.95), 1) AS gpu_util_p95_pct,
      round(stddev_pop(value), 2) AS gpu_util_stddev_pct
    FROM events GROUP BY event_type
    """,
)
def gpu_stats(t):
    return TEL.gpu_stats(t.events, ["event_type"], "value")


# Histograms: how many events up to a time were at most ``le``, per run and user group.
_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
_HIST_SQL = f"""
    e AS (SELECT event_type AS run, user_id % 3 AS g, value, ts < TIMESTAMP '2024-01-10' AS early FROM events),
    b AS (SELECT run, g, le, count(*) - count(*) FILTER (early) AS cnt
      FROM e JOIN (SELECT unnest({list(_BOUNDS)}) AS le) ON value <= le GROUP BY ALL),
    n AS (SELECT run, count(*) FILTER (NOT early) AS total FROM e GROUP BY run)
    """


def histogram_samples(t):
    """Cumulative bucket and count rows of the start (early events) and end (all events) snapshots."""
    base = "vllm:time_to_first_token_seconds"
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    group = F.concat(F.lit('g="'), (F.col("user_id") % 3).cast("string"), F.lit('"'))
    rows = t.events.select(
        F.col("event_type").alias("run"),
        F.explode(F.when(early, F.array(F.lit("start"), F.lit("end"))).otherwise(F.array(F.lit("end")))).alias("phase"),
        group.alias("_group"),
        "value",
    )
    metrics = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(f"{base}_bucket").alias("name"),
                    F.concat("_group", F.lit(f',le="{b}"')).alias("labels"),
                    (F.col("value") <= b).alias("hit"),
                )
                for b in _BOUNDS
            ],
            F.struct(
                F.lit(f"{base}_bucket").alias("name"),
                F.concat("_group", F.lit(',le="+Inf"')).alias("labels"),
                F.lit(True).alias("hit"),
            ),
            F.struct(F.lit(f"{base}_count").alias("name"), F.col("_group").alias("labels"), F.lit(True).alias("hit")),
        ),
        lambda m: m["hit"],
    )
    return (
        rows.select("run", "phase", F.explode(metrics).alias("m"))
        .groupBy("run", "phase", F.col("phase").alias("sample"), F.col("m.name").alias("name"), F.col("m.labels").alias("labels"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


@query(
    "histogram_percentiles",
    f"""
    WITH {_HIST_SQL},
    o AS (SELECT *, row_number() OVER w AS rn, lag(le, 1, 0) OVER w AS prev_le, lag(cnt, 1, 0) OVER w AS prev_cnt,
        max(le) OVER (PARTITION BY run) AS last_le
      FROM b WINDOW w AS (PARTITION BY run ORDER BY le, cnt)),
    p AS (SELECT run, pct, pct / 100.0 * total AS target FROM n, (SELECT unnest([50.0, 95.0]::DOUBLE[]) AS pct)),
    f AS (SELECT run, pct, any_value(target) AS target, any_value(last_le) AS last_le,
        arg_min(o, rn) FILTER (cnt >= target) AS h FROM o JOIN p USING (run) GROUP BY run, pct)
    SELECT run, 'vllm:time_to_first_token_seconds' AS base, pct,
      round(1000 * CASE WHEN h IS NULL THEN last_le WHEN h.cnt = h.prev_cnt THEN h.le
        ELSE h.prev_le + (h.le - h.prev_le) * (target - h.prev_cnt) / (h.cnt - h.prev_cnt) END, 1) AS value_ms
    FROM f
    """,
)
def histogram_percentiles(t):
    return TEL.histogram_percentiles(
        histogram_samples(t), ["vllm:time_to_first_token_seconds"], [50, 95], ["run"]
    )


@query(
    "histogram_percentiles_merged",
    f"""
    WITH {_HIST_SQL},
    s AS (SELECT run, le, sum(cnt) AS cnt FROM b GROUP BY ALL),
    o AS (SELECT *, row_number() OVER w AS rn, lag(le, 1, 0) OVER w AS prev_le, lag(cnt, 1, 0) OVER w AS prev_cnt,
        max(le) OVER (PARTITION BY run) AS last_le FROM s WINDOW w AS (PARTITION BY run ORDER BY le)),
    p AS (SELECT run, pct, pct / 100.0 * total AS target FROM n, (SELECT unnest([50.0, 99.0]::DOUBLE[]) AS pct)),
    f AS (SELECT run, pct, any_value(target) AS target, any_value(last_le) AS last_le,
        arg_min(o, rn) FILTER (cnt >= target) AS h FROM o JOIN p USING (run) GROUP BY run, pct)
    SELECT run, 'vllm:time_to_first_token_seconds' AS base, pct,
      round(1000 * CASE WHEN h IS NULL THEN last_le WHEN h.cnt = h.prev_cnt THEN h.le
        ELSE h.prev_le + (h.le - h.prev_le) * (target - h.prev_cnt) / (h.cnt - h.prev_cnt) END, 1) AS value_ms
    FROM f
    """,
)
def histogram_percentiles_merged(t):
    return TEL.histogram_percentiles(
        histogram_samples(t), ["vllm:time_to_first_token_seconds"], [50, 99], ["run"], merge_series=True
    )


@query(
    "server_summary",
    f"""
    WITH {_HIST_SQL},
    o AS (SELECT *, row_number() OVER w AS rn, lag(le, 1, 0) OVER w AS prev_le, lag(cnt, 1, 0) OVER w AS prev_cnt,
        max(le) OVER (PARTITION BY run) AS last_le
      FROM b WINDOW w AS (PARTITION BY run ORDER BY le, cnt)),
    p AS (SELECT run, pct, pct / 100.0 * total AS target FROM n, (SELECT unnest([50.0, 95.0]::DOUBLE[]) AS pct)),
    f AS (SELECT run, pct, any_value(target) AS target, any_value(last_le) AS last_le,
        arg_min(o, rn) FILTER (cnt >= target) AS h FROM o JOIN p USING (run) GROUP BY run, pct),
    q AS (SELECT run, pct, round(1000 * CASE WHEN h IS NULL THEN last_le WHEN h.cnt = h.prev_cnt THEN h.le
        ELSE h.prev_le + (h.le - h.prev_le) * (target - h.prev_cnt) / (h.cnt - h.prev_cnt) END, 1) AS value_ms FROM f),
    g AS (SELECT run, phase, sample, sum(value) FILTER (name = 'cache') AS cache,
        sum(value) FILTER (name = 'running') AS running FROM {_PHASE_SAMPLES} GROUP BY ALL)
    SELECT run, 0.0::DOUBLE AS vllm_request_throughput_req_per_sec, 0.0::DOUBLE AS vllm_token_throughput_tok_per_sec,
      (SELECT value_ms FROM q WHERE q.run = g.run AND pct = 50) AS vllm_ttft_p50_ms,
      (SELECT value_ms FROM q WHERE q.run = g.run AND pct = 95) AS vllm_ttft_p95_ms,
      NULL::DOUBLE AS vllm_itl_p50_ms, NULL::DOUBLE AS vllm_itl_p95_ms,
      round(avg(cache) FILTER (phase = 'poll') * 100, 4) AS vllm_kv_cache_usage_avg_pct,
      round(max(coalesce(cache, 0)) FILTER (phase = 'poll') * 100, 4) AS vllm_kv_cache_peak_pct,
      round(avg(coalesce(running, 0)) FILTER (phase = 'poll'), 2) AS vllm_effective_batch_size_avg,
      count(*) FILTER (phase = 'poll') AS vllm_scrape_count
    FROM g GROUP BY run
    """,
)
def server_summary(t):
    """Gauges and histograms of each run in one summary; these runs have no counters."""
    gauges = phase_samples(t).withColumn(
        "name", F.when(F.col("name") == "cache", TEL.CACHE).otherwise(TEL.RUNNING)
    )
    samples = gauges.unionByName(histogram_samples(t))
    return TEL.server_summary(samples, 3600.0, ["run"])


@query(
    "exposition_parse",
    """
    WITH lines AS (SELECT strftime(ts, '%Y-%m-%d') AS sample, event_id, 'm_' || event_type AS name,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user="' || user_id || '"' END AS labels, value, event_id % 11 AS c FROM events)
    SELECT sample, name, labels, arg_max(value, event_id) AS value FROM lines
    WHERE c NOT IN (0, 1, 2, 3) GROUP BY ALL
    """,
)
def exposition_parse(t):
    """Exposition lines with comments, blanks, non-numbers and spaced labels between good ones."""
    c = F.col("event_id") % 11
    name = F.concat(F.lit("m_"), "event_type")
    label = F.concat(F.lit('user="'), F.col("user_id").cast("string"))
    full = F.when(F.col("event_id") % 3 == 0, name).otherwise(
        F.concat(name, F.lit("{"), label, F.when(c == 3, " x").otherwise(""), F.lit('"}'))
    )
    line = (
        F.when(c == 0, F.concat(F.lit("# HELP "), full))
        .when(c == 1, F.lit("  "))
        .when(c == 2, F.concat(full, F.lit(" NaN")))
        .when((c == 3) & (F.col("event_id") % 3 == 0), F.concat(full, F.lit(" +Inf")))
        .otherwise(F.concat(full, F.lit(" "), "value", F.lit(" 1700000000")))
    )
    lines = t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("sample"), F.col("event_id").alias("seq"), line.alias("line")
    )
    return TS.parse_exposition(lines, ["sample"])


@query(
    "snapshot_files",
    """
    SELECT 'm_' || event_type AS name, 'day="' || strftime(ts, '%d') || '"' AS labels, max(event_id)::DOUBLE AS value
    FROM events GROUP BY ALL
    """,
)
def snapshot_files(t):
    """Exposition text written to files and read back."""
    folder = scratch_dir(t.spark, "snapshots")
    rows = t.events.groupBy("event_type", F.date_format("ts", "dd").alias("day")).agg(
        F.max("event_id").alias("value")
    )
    text = F.concat(
        F.lit("# TYPE gauge\nm_"), "event_type", F.lit('{day="'), "day", F.lit('"} '), F.col("value").cast("string")
    )
    rows.select(text.alias("value")).write.text(folder)
    return TS.read_snapshots(t.spark, folder).select("name", "labels", "value")


@query(
    "stream_gauges",
    """
    SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS samples, round(avg(value), 9) AS avg_value,
      max(value) AS peak_value, round(stddev_pop(value), 9) AS stddev_value,
      quantile_disc(value, 0.5) AS p50_value, quantile_disc(value, 0.95) AS p95_value
    FROM events GROUP BY ALL
    """,
)
def stream_gauges(t):
    """Daily gauge windows computed by a stream over the events.

    Each micro-batch stores the windows it changed; reading takes the last state of each.
    """
    work = scratch_dir(t.spark, "gauges")
    events = (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
    )
    out = windowed_gauges(events, "ts", "value", "1 day", "1 hour", ("event_type",))
    query_ = (
        out.writeStream.outputMode("update")
        .option("checkpointLocation", f"{work}/state")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, i: sinks.append_batch(df, f"{work}/out", i))
        .start()
    )
    query_.awaitTermination()
    kept = ("samples", "avg_value", "peak_value", "stddev_value", "approx_p50_p95")
    last = F.max_by(F.struct(*kept), "batch_id").alias("last")
    stored = t.spark.read.parquet(f"{work}/out").groupBy("window_start", "event_type").agg(last)
    return stored.select("window_start", "event_type", "last.*").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "samples",
        F.round("avg_value", 9).alias("avg_value"), "peak_value",
        F.round("stddev_value", 9).alias("stddev_value"),
        # ranks are exact as long as a window holds fewer samples than the sketch's accuracy
        F.col("approx_p50_p95")[0].alias("p50_value"), F.col("approx_p50_p95")[1].alias("p95_value"),
    )
