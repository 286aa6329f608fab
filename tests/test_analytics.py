"""Metrics, telemetry, sampling, jobs and catalog on hand-computed data."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import catalog as C
from millrace.operators import jobs as OPS
from millrace.operators import metrics as M
from millrace.operators import sampling as S
from millrace.operators import telemetry as TEL
from millrace.operators.requests import CATEGORIES
from millrace.operators.quantiles import approximate_quantiles, exact_quantiles
from millrace.operators.ranking import number_rows
from millrace.plans import benchmark_requests
from millrace.sources import catalog as CAT
from millrace.sources import jobs as JS
from millrace.sources import telemetry as TS

RUN_SCHEMA = "error string, latency_ms double, retry_count bigint, tokens bigint"


def test_run_metrics_of_three_results(spark):
    rows = spark.createDataFrame(
        [(None, 10.0, 1, 12), (None, 20.0, 0, 8), ("timeout exceeded", 30.0, 2, 0)], RUN_SCHEMA
    )
    got = M.run_metrics(rows, 2.0).first().asDict(recursive=True)
    assert got == {
        "elapsed_sec": 2.0, "successful_req_per_sec": 1.0, "request_latency_p50_ms": 20.0,
        "request_latency_p95_ms": 29.0, "request_latency_p99_ms": 29.8, "retry_count_total": 3,
        "retry_rate_pct": 66.67, "avg_retries_per_request": 1.0, "retry_success_rate_pct": 50.0,
        "error_rate_by_type_pct": {"timeout": 33.33, "rate_limit": 0.0, "server": 0.0, "validation": 0.0, "other": 0.0},
        "output_tokens_avg": 10.0, "output_tokens_p95": 11.8, "successful_tok_per_sec": 10.0,
    }


def test_run_metrics_edges(spark):
    empty = M.run_metrics(spark.createDataFrame([], RUN_SCHEMA), 0.0).first()
    assert empty.successful_req_per_sec is None and empty.request_latency_p50_ms is None
    assert empty.retry_rate_pct == 0.0 and empty.output_tokens_avg == 0.0 and empty.retry_success_rate_pct is None
    assert empty.error_rate_by_type_pct.other == 0.0 and empty.output_tokens_p95 == 0.0
    blank = spark.createDataFrame([("", None, None, 3)], RUN_SCHEMA)
    assert M.success_summary(blank).first().success_rate_pct == 100.0
    assert M.run_metrics(blank, 1.0).first().retry_count_total == 0
    per_run = blank.withColumn("run", F.lit("r")).withColumn("sec", F.lit(4.0))
    assert M.run_metrics(per_run, F.max("sec"), ["run"]).first().successful_req_per_sec == 0.25


def test_report_has_thirty_rows(spark):
    rows = spark.createDataFrame([(None, 10.0, 0, 2)], RUN_SCHEMA)
    report = M.metrics_report(M.run_metrics(rows, 1.0)).collect()
    assert [r.position for r in report] == list(range(30))
    shown = {r.label: (r.value, r.unit) for r in report}
    assert shown["Request latency p50"] == ("10.0", "ms") and shown["Total requests"] == ("N/A", "")
    rates = {"timeout": 0.0, "rate_limit": 0.0, "server": 0.0, "validation": 0.0, "other": 0.0}
    assert shown["Error rate by type"] == (str(rates), "")


@pytest.mark.parametrize("seed", range(3))
def test_exact_quantiles_like_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {
        "one": [5.0],
        "same": [2.5] * 40,
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(500)] + [0.0] * 7,
        "near": [1.0 + rng.randrange(1000) * 2**-50 for _ in range(300)],
        None: [float(rng.randrange(100)) for _ in range(200)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    probs = {f"p{i}": p for i, p in enumerate((0.0, 0.05, 0.5, 0.95, 0.99, 1.0))}
    got = {r.g: r for r in exact_quantiles(rows, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(float(np.percentile(values, p * 100)), rel=1e-12, abs=1e-300)


def test_approximate_quantiles_stay_close(spark):
    rows = spark.range(10001).select(F.col("id").cast("double").alias("v"))
    row = approximate_quantiles(rows, "v", {"p50": 0.5}).first()
    assert row.n == 10001 and abs(row.p50 - 5000) <= 2


def test_row_numbers_over_skewed_and_sparse_keys(spark):
    ids = list(range(0, 3000)) + [2**40 + i * 70001 for i in range(500)] + [-5, -70000]
    rows = spark.createDataFrame([(i,) for i in ids], "k bigint").repartition(5)
    got = [(r.k, r.row_number) for r in number_rows(rows, "k").orderBy("k").collect()]
    assert got == [(k, n) for n, k in enumerate(sorted(ids))]


def test_batches_and_save_points(spark):
    rows = S.batch_chunks(spark.range(210), "id", 4, 50).orderBy("id").collect()
    assert [r.batch_id for r in rows] == [i // 4 for i in range(210)]
    assert [r.id for r in rows if r.save_point] == [99, 199]


def test_synthetic_prompts(spark):
    def texts(n, seed):
        rows = S.synthetic_prompts(spark, n, seed).orderBy("seq")
        return [(r.custom_id, r.b) for r in rows.select("custom_id", F.to_json("body").alias("b")).collect()]

    assert [i for i, _ in texts(3, 1)] == ["bench-0000", "bench-0001", "bench-0002"]
    assert texts(10, 1) == texts(10, 1) and texts(10, 1) != texts(10, 99)
    body = json.loads(texts(1, 1)[0][1])
    assert body["max_tokens"] == 512 and body["temperature"] == 0.7 and body["model"] == "llama3.2:3b"


def test_prompt_subsets(spark):
    pool = spark.range(10)
    assert [S.prompt_subset(pool, n, "id").count() for n in (0, -1, 4, 100)] == [0, 10, 4, 10]
    draw = lambda seed: {r.id for r in S.prompt_subset(pool, 4, "id", seed).collect()}
    assert draw(1) == draw(1) and any(draw(1) != draw(s) for s in range(2, 8))


def test_stratified_sample_with_a_hot_category(spark):
    pool = spark.range(3000).withColumn(
        "c", F.when(F.col("id") < 2500, "math").when(F.col("id") < 2990, "coding").when(F.col("id") < 2996, "language").otherwise("other")
    )
    rows = S.stratified_sample(pool, 60, "c", "id").collect()
    sizes = {c: sum(r.c == c for r in rows) for c in ("math", "coding", "language", "other")}
    assert sizes == {"math": 10, "coding": 10, "language": 6, "other": 0}
    assert {r.c: r.category_pos for r in rows} == {"language": 2, "math": 3, "coding": 6}
    assert S.stratified_sample(pool, 5, "c", "id").count() == 0


def test_sampled_requests_ids(spark):
    pool = spark.range(2).select(F.col("id").alias("seq"), F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("m"))
    assert [r.custom_id for r in S.sampled_requests(pool, "m", None).collect()] == ["request1", "request1"]
    assert [r.custom_id for r in S.sampled_requests(pool, "m", "seq").collect()] == ["0", "1"]


def test_exposition_text(spark, tmp_path):
    (tmp_path / "s.prom").write_text(
        '# HELP m\n\nm 1\nm{a="x"} 2\nm{a="x y"} 3\nn NaN\ni +Inf\nd{k="v"} 1e3 1700000000\nd{k="v"} -2.5\n'
    )
    rows = TS.read_snapshots(spark, str(tmp_path)).collect()
    assert {(r.name, r.labels): r.value for r in rows} == {("m", ""): 1.0, ("m", 'a="x"'): 2.0, ("d", 'k="v"'): -2.5}


SAMPLES = "phase string, sample string, name string, labels string, value double"


def reference_percentile(end, start, total, pct):
    """The sequential definition: walk the sorted buckets up to the target."""
    buckets = sorted((le, c - start.get((le, g), 0.0)) for (le, g), c in end.items())
    target, prev = pct / 100.0 * total, (0.0, 0.0)
    for le, count in buckets:
        if count >= target:
            if count == prev[1]:
                return round(le * 1000, 1)
            return round((prev[0] + (le - prev[0]) * (target - prev[1]) / (count - prev[1])) * 1000, 1)
        prev = (le, count)
    return round(buckets[-1][0] * 1000, 1)


def hist_rows(phase, cells, total):
    rows = [(phase, phase, "h_bucket", f'g="{g}",le="{le}"', c) for (le, g), c in cells.items()]
    rows.append((phase, phase, "h_bucket", 'g="0",le="+Inf"', 1e9))
    return [*rows, (phase, phase, "h_count", "", total)]


def test_histogram_percentile(spark):
    les = (0.1, 0.5, 1.0)
    start = {(le, 0): c for le, c in zip(les, (2.0, 4.0, 5.0))}
    end = {(le, 0): c for le, c in zip(les, (4.0, 10.0, 15.0))}
    rows = spark.createDataFrame(hist_rows("start", start, 5.0) + hist_rows("end", end, 15.0), SAMPLES)
    got = TEL.histogram_percentiles(rows, ["h", "absent"], [50]).collect()
    assert [(r.base, r.value_ms) for r in got] == [("h", 400.0)]


@pytest.mark.parametrize("seed", range(4))
def test_histogram_percentiles_of_interleaved_series(spark, seed):
    rng = random.Random(seed)
    end, start = {}, {}
    for g in range(3):
        c = s = 0.0
        for le in (0.05, 0.1, 0.5, 1.0, 5.0):
            s += rng.randrange(5)
            c = max(c, s) + rng.randrange(6)
            end[(le, g)] = c
            if rng.random() < 0.8:
                start[(le, g)] = s
    total = 30.0
    rows = spark.createDataFrame(hist_rows("start", start, 0.0) + hist_rows("end", end, total), SAMPLES)
    got = {r.pct: r.value_ms for r in TEL.histogram_percentiles(rows, ["h"], [10, 50, 95, 99.9]).collect()}
    for pct, value in got.items():
        assert value == pytest.approx(reference_percentile(end, start, total, pct), abs=0.11)


def test_server_summary(spark):
    rows = [
        ("start", "s", TEL.REQUESTS, "", 10.0), ("end", "e", TEL.REQUESTS, "", 30.0),
        ("start", "s", TEL.TOKENS, 'm="a"', 100.0), ("end", "e", TEL.TOKENS, 'm="a"', 150.0), ("end", "e", TEL.TOKENS, 'm="b"', 50.0),
        ("poll", "1", TEL.CACHE, "", 0.2), ("poll", "2", TEL.CACHE, "", 0.4), ("poll", "3", "x", "", 1.0),
        ("poll", "1", TEL.RUNNING, "", 3.0),
    ]
    got = TEL.server_summary(spark.createDataFrame(rows, SAMPLES), 10.0).first()
    assert got.vllm_request_throughput_req_per_sec == 2.0 and got.vllm_token_throughput_tok_per_sec == 10.0
    assert got.vllm_kv_cache_usage_avg_pct == 30.0 and got.vllm_kv_cache_peak_pct == 40.0
    assert got.vllm_effective_batch_size_avg == 1.0 and got.vllm_scrape_count == 3
    assert got.vllm_ttft_p50_ms is None
    no_polls = [r for r in rows if r[0] != "poll"] + [("start", "s", TEL.CACHE, "", 0.1), ("end", "e", TEL.CACHE, "", 0.3)]
    got = TEL.server_summary(spark.createDataFrame(no_polls, SAMPLES), 10.0).first()
    assert got.vllm_kv_cache_usage_avg_pct == 20.0 and got.vllm_kv_cache_peak_pct is None
    assert got.vllm_effective_batch_size_avg is None and got.vllm_scrape_count == 0
    no_end = spark.createDataFrame([r for r in rows if r[0] != "end"], SAMPLES)
    assert TEL.server_summary(no_end, 10.0).count() == 0
    assert TEL.server_summary(spark.createDataFrame(rows, SAMPLES), 0.0).count() == 0


def test_gpu_stats(spark):
    values = [0.0, 37.5, 80.0, 99.0, 100.0, 3.25]
    rows = spark.createDataFrame([(v,) for v in values], "util double")
    got = TEL.gpu_stats(rows).first()
    q = statistics.quantiles(values, n=100, method="inclusive")
    assert got.gpu_util_p50_pct == pytest.approx(round(q[49], 1), abs=0.06)
    assert got.gpu_util_p95_pct == pytest.approx(round(q[94], 1), abs=0.06)
    assert got.gpu_util_stddev_pct == round(statistics.pstdev(values), 2) and got.gpu_util_peak_pct == 100.0
    one = TEL.gpu_stats(rows.limit(1)).first()
    assert one.gpu_util_p50_pct == one.gpu_util_p95_pct
    assert TEL.gpu_stats(rows.limit(0)).first().gpu_util_avg_pct is None


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_job_joins_broadcast_neither_side(spark):
    registry = JS.registry_jobs(spark.sql("SELECT '{\"1\": {\"job_name\": \"a\"}}' AS value"))
    docs = spark.sql("SELECT '{\"jobs\": [{\"job_id\": 1, \"state\": \"RUNNING\"}]}' AS value")
    accounting = JS.accounting_jobs(JS.accounting_entries(docs))
    for jobs in (OPS.all_jobs(registry, accounting), OPS.active_jobs(registry, accounting), OPS.running_jobs(registry, accounting)):
        plan = jobs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert [r.job_id for r in jobs.collect()] == ["1"]


def test_job_history(spark, tmp_path):
    registry = JS.read_registry(spark, write(tmp_path / "r.json", {
        "100": {"job_name": "a", "model": "m", "engine": "vllm", "submitted_at": "2024-01-01T10:00:00Z", "logs_dir": "/l/"},
        "200": {"type": "serve", "submitted_at": 1700000000},
        "300": "not an entry",
    }))
    accounting = JS.read_accounting(spark, write(tmp_path / "a.json", {"jobs": [
        {"job_id": 100, "state": "PENDING"},
        {"job_id": 100, "state": {"current": ["RUNNING"]}, "partition": " gpu ", "time": {"start": 1700000000, "elapsed": 61, "limit": {"set": True, "infinite": False, "number": 90}}, "stdout_expanded": "/o"},
        {"job_id": "100", "state": "FAILED"}, {"job_id": 0, "state": "FAILED"}, {"state": "FAILED"}, 7,
        {"job_id": 900, "job_state": ["completed"], "name": "n", "Nodes": "n1", "work_dir": "/w"},
        {"job_id": "100.batch", "state": "FAILED"},
    ]}))
    listed = {r.job_id: r for r in OPS.all_jobs(registry, accounting).collect()}
    assert set(listed) == {"100", "200"}
    assert (listed["100"].state, listed["100"].elapsed, listed["100"].submitted) == ("RUNNING", "00:01:01", "2024-01-01 10:00:00")
    assert (listed["200"].state, listed["200"].type, listed["200"].name, listed["200"].elapsed) == ("UNKNOWN", "serve", "--", "--")
    assert [r.job_id for r in OPS.newest_first(OPS.all_jobs(registry, accounting)).collect()] == ["100", "200"]
    assert [r.job_id for r in OPS.all_jobs(registry, accounting, ["unknown"]).collect()] == ["200"]
    assert [r.job_id for r in OPS.active_jobs(registry, accounting).collect()] == ["100"]
    assert OPS.active_jobs(registry, accounting, ["pending"]).count() == 0
    assert [r.job_id for r in OPS.running_jobs(registry, accounting).collect()] == ["100"]
    details = {r.job_id: r for r in OPS.job_details(registry, accounting).collect()}
    assert set(details) == {"100", "200", "900"}
    d = details["100"]
    assert (d.partition, d.time_limit, d.start, d.log_stdout, d.log_stderr) == ("gpu", "01:30:00", "2023-11-14 22:13:20", "/o", "/l/100.err")
    d = details["900"]
    assert (d.name, d.state, d.nodes, d.working_dir, d.tracked, d.log_stdout) == ("n", "COMPLETED", "n1", "/w", False, "--")
    for broken in ([1, 2], {"jobs": {"a": 1}}, {}):
        assert JS.read_accounting(spark, write(tmp_path / "b.json", broken)).count() == 0
    assert JS.read_registry(spark, write(tmp_path / "c.json", [1])).count() == 0


def test_builtin_catalog(spark):
    table = C.with_engines(CAT.catalog_table(spark))
    rows = {r.key: r for r in table.collect()}
    assert len(rows) == 88 and sum(r.name == "NA" for r in rows.values()) == 21
    assert rows["QwQ-32B"].engines == ["vllm"] and rows["Qwen3-8B"].engines == ["ollama", "vllm"]
    assert C.check_quality(table).where("NOT valid").count() == 0
    spec = CAT.load_model("Llama-3.2-3B-Instruct", "ollama")
    assert (spec.engine_name, spec.stop_sequences, spec.max_tokens) == ("llama3.2:3b", ("###",), 2048)
    assert CAT.load_model("nope") is None


def test_custom_catalogs(tmp_path):
    entry = {"name": "n", "hf_name": "h/n", "parameters": {"temperature": 0.1}}
    shapes = [{"models": {"k": entry}}, {"k": entry}, entry]
    for i, shape in enumerate(shapes):
        path = write(tmp_path / f"{i}.json", shape)
        spec = CAT.load_model("k", custom_path=path)
        assert (spec.hf_name, spec.temperature, spec.top_p) == ("h/n", 0.1, 0.9)
    assert CAT.load_model("other", custom_path=write(tmp_path / "m.json", shapes[0])) is None
    assert CAT.load_model("k", custom_path=write(tmp_path / "l.json", [1])) is None
    assert CAT.load_model("k", custom_path=str(tmp_path / "absent.json")) is None


def test_quality_rules(spark):
    rows = spark.createDataFrame(
        [("ok", 0.5, "80GB", [1, 4]), ("hot", 1.5, "80GB", [1, 4]), ("mem", 0.5, "80", [1, 4]), ("span", 0.5, "8GB", [4, 1])],
        "key string, temperature double, gpu_memory string, batch_size_range array<bigint>",
    )
    found = {r.key: r.violations for r in C.check_quality(rows).collect()}
    assert found == {"ok": [], "hot": ["temperature in [0,1]"], "mem": ["gpu_memory format"], "span": ["batch_size_range"]}


def test_benchmark_prompts_in_category_order(spark):
    names = ["math", "coding", "language", "reasoning", "data_analysis", "instruction_following"]
    rows = [(i, names[i % 6], [f"t{i}", "again"]) for i in range(30)]
    dataset = spark.createDataFrame(rows, "id int, category string, turns array<string>")
    out = benchmark_requests(dataset, 13).orderBy("seq").select("custom_id", F.to_json("body").alias("b")).collect()
    assert [r.custom_id.rsplit("-", 1)[0] for r in out] == [c for c in CATEGORIES for _ in range(2)]
    messages = json.loads(out[0].b)["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "user"]
    assert "data analysis" in messages[0]["content"]
    same = benchmark_requests(dataset, 13, unique_ids=False).collect()
    assert {r.custom_id for r in same} == {"request1"}


@pytest.mark.parametrize("bound", [1, None])
def test_quantiles_of_close_and_of_equal_values(spark, bound):
    """Values inside one bin, down to their last bits, and one value that half of the rows have."""
    base = 1.7e9  # seconds of three days lie in one bin
    close = [base + i * 37.0 + (i % 5) * 2.0**-22 for i in range(3000)]
    values = close + [base + 1000.0] * 3000
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    probs = {"p05": 0.05, "p50": 0.5, "p77": 0.77, "p99": 0.99}
    got = exact_quantiles(rows, "v", probs, max_keys=bound).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(np.array(values), p), abs=1e-6)
    keyed = exact_quantiles(rows.selectExpr("v", "cast(v as long) % 2 AS k"), "v", probs, ["k"], max_keys=bound and 2)
    for r in keyed.collect():
        own = np.array([v for v in values if int(v) % 2 == r.k])
        assert r.n == len(own) and r.p77 == pytest.approx(np.quantile(own, 0.77), abs=1e-6)
