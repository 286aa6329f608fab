"""Resolution, inference, results, whole runs and streaming."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import infer as INF
from millrace.operators import metrics as M
from millrace.operators import resolve as RES
from millrace.plans import run_batch, run_summary
from millrace.sources import results as RS
from millrace.sources.catalog import ModelSpec
from millrace.streaming import stream_requests

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = ModelSpec("k", name="test/test-model", engine="ollama", temperature=0.7, max_tokens=500, top_p=0.9, stop_sequences=("###",))


class Echo:
    """Answers with the last message; fails on request."""

    def __call__(self, payload):
        text = payload["messages"][-1]["content"]
        if text.startswith("fail"):
            raise TimeoutError(text)
        if text == "odd":
            return {"unexpected": 1}
        return {"choices": [{"message": {"content": text.upper()}}], "usage": {"completion_tokens": len(text)}}


def items(spark, values):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "seq int, j string")
    return RES.requests_from_lines(rows.select("seq", F.parse_json("j").alias("item")))


def chat(text, **body):
    return {"custom_id": text, "body": {"messages": [{"role": "user", "content": text}], **body}}


def payloads(spark, values, **kw):
    rows = RES.resolve_requests(items(spark, values), MODEL, **kw).orderBy("seq").collect()
    return [r.payload and json.loads(r.payload) for r in rows], [r.resolve_error for r in rows]


def test_parameter_precedence(spark):
    (body_first, defaults, config), _ = (
        payloads(spark, [chat("a", max_tokens=7, temperature=0.0, top_k=2), chat("b")], defaults={"max_tokens": 32, "temperature": 0.2, "top_k": 5, "top_p": None})[0]
        + payloads(spark, [chat("c", n=3, stop=[])])[0],
        None,
    )
    assert (body_first["max_tokens"], body_first["temperature"], body_first["top_k"], body_first["top_p"]) == (7, 0.0, 2, 0.9)
    assert (defaults["max_tokens"], defaults["temperature"], defaults["top_k"]) == (32, 0.2, 5)
    assert (config["max_tokens"], config["temperature"], config["top_p"]) == (500, 0.7, 0.9)
    assert "top_k" not in config and "n" not in config and "stop" not in config
    assert defaults["stop"] == ["###"] and defaults["stream"] is False
    (null_body,), _ = payloads(spark, [chat("d", temperature=None, stop=None)], defaults={"temperature": 0.2})
    assert null_body["temperature"] is None and "stop" not in null_body


def test_routing_and_model_check(spark):
    values = [
        {"url": "/v1/embeddings", "body": {"messages": []}},
        {"url": "/v1/completions", "body": {"prompt": "p"}},
        {"url": None},
        chat("x", model="different/model"),
        chat("y", model=""),
        {},
        {"body": None},
    ]
    calls, errors = payloads(spark, values)
    assert errors == [
        "Unsupported URL: /v1/embeddings", None, "Unsupported URL: None",
        "JSONL model 'different/model' does not match requested model 'test/test-model'", None, None, "body is not an object",
    ]
    assert calls[1]["messages"] == [{"role": "user", "content": "p"}]
    assert calls[4]["model"] == "test/test-model"
    assert calls[5]["messages"] == []


def test_engine_names():
    spec = ModelSpec("k", name="n", hf_name="h/n")
    assert spec.engine_name == "h/n"
    assert ModelSpec("k", name="n", engine="ollama").engine_name == "n"
    with pytest.raises(ValueError):
        ModelSpec("k", name="n").engine_name
    for spec in (ModelSpec("k", name="NA", engine="ollama"), ModelSpec("k", name="n"), ModelSpec("k", name="n", engine="x")):
        with pytest.raises(ValueError):
            spec.require_available()


def run(spark, values, retries=3):
    resolved = RES.resolve_requests(items(spark, values), MODEL)
    called = INF.infer(resolved, Echo, retries, 0.0)
    shaped = INF.shape_results(called, MODEL.engine_name)
    out = shaped.select("seq", INF.result_json()).orderBy("seq").collect()
    return [json.loads(r.line) for r in out]


def test_results(spark):
    good, text, bad, odd, routed = run(
        spark,
        [
            {**chat("hello"), "metadata": {"tag": 1}},
            {"custom_id": "t", "url": "/v1/completions", "body": {"prompt": "pp"}},
            chat("fail: timed out"),
            {**chat("odd"), "metadata": {"retry_count": 9, "model": "mine"}},
            {"custom_id": "e", "url": "/v1/embeddings", "body": {}},
        ],
    )
    assert good["output"]["choices"] == [
        {"index": 0, "message": {"role": "assistant", "content": "HELLO"}, "finish_reason": "stop"}
    ]
    assert good["output"]["object"] == "chat.completion" and good["output"]["usage"] == {"completion_tokens": 5}
    assert good["metadata"]["tag"] == 1 and good["metadata"]["retry_count"] == 0
    assert good["metadata"]["url"] == "/v1/chat/completions" and good["metadata"]["method"] == "POST"
    assert good["input"]["metadata"] == {"tag": 1} and "error" not in good
    assert text["output"]["object"] == "text_completion"
    assert text["output"]["choices"] == [{"text": "PP", "index": 0, "finish_reason": "stop"}]
    assert bad["error"] == "fail: timed out" and "output" not in bad
    assert bad["metadata"]["error"] is True and bad["metadata"]["retry_count"] == 3
    assert odd["output"]["choices"][0]["message"]["content"] == "" and odd["output"]["usage"] == {}
    assert odd["metadata"]["retry_count"] == 9 and odd["metadata"]["model"] == "mine"
    assert routed["error"] == "Unsupported URL: /v1/embeddings" and routed["metadata"]["retry_count"] == 3


def test_retries_until_success(spark, tmp_path):
    marker = str(tmp_path / "calls")

    class Flaky:
        def __call__(self, payload):
            with open(marker, "a") as handle:
                handle.write("x")
            with open(marker) as handle:
                if len(handle.read()) < 3:
                    raise ValueError("not yet")
            return {"choices": [{"message": {"content": "ok"}}]}

    resolved = RES.resolve_requests(items(spark, [chat("a")]), MODEL)
    row = INF.infer(resolved, Flaky, 3, 0.0).select("retry_count", "error", "latency_ms").first()
    assert (row.retry_count, row.error) == (2, None) and row.latency_ms >= 0


def test_batch_run_calls_the_model_once_per_request(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    class Counting(Echo):
        def __call__(self, payload):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return super().__call__(payload)

    source = tmp_path / "in.jsonl"
    source.write_text("# head\n" + "\n".join(json.dumps(chat(f"text {i}")) for i in range(20)) + "\n{broken\n")
    out = run_batch(spark, str(source), str(tmp_path / "out"), MODEL, Counting, retry_delay=0.0, warm=False)
    assert out.results.count() == 20
    gpu = spark.createDataFrame([(55.0,)], "gpu_util_avg_pct double")
    summary = run_summary(out.metrics, gpu).first()
    assert summary.gpu_util_avg_pct == 55.0
    assert (summary.total_requests, summary.failed_requests, summary.success_rate_pct) == (20, 0, 100.0)
    assert summary.output_tokens_avg == 6.5
    ordered = [r.custom_id for r in out.results.orderBy("seq").collect()]
    assert ordered == [f"text {i}" for i in range(20)]
    assert len(list(calls.iterdir())) == 20
    sinks.write_envelope(
        out.results, {"vllm_metrics": {}, "gpu_metrics": {"gpu_util_avg_pct": None}, "run_metrics": {"elapsed_sec": 1.0}},
        str(tmp_path / "envelope"),
    )
    whole = "".join(p.read_text() for p in sorted((tmp_path / "envelope").glob("part-*")))
    envelope = json.loads(whole)
    assert list(envelope) == ["results", "gpu_metrics", "run_metrics"] and len(envelope["results"]) == 20
    target = tmp_path / "one.json"
    target.write_text(whole)
    legacy = tmp_path / "legacy.json"
    legacy.write_text(json.dumps(envelope["results"]))
    for path, metrics in ((target, {"elapsed_sec": "1.0", "gpu_util_avg_pct": None}), (legacy, {})):
        results, maps = RS.read_run_file(spark, str(path))
        assert results.count() == 20
        merged = M.envelope_metrics(results, maps)
        assert merged.first().metrics == {
            "total_requests": "20", "successful_requests": "20", "failed_requests": "0",
            "success_rate_pct": "100.0", **metrics,
        }
        shown = {r.label: (r.value, r.unit) for r in M.metrics_report(M.metrics_of_map(merged)).collect()}
        assert shown["Successful"] == ("20", "") and shown["GPU utilization avg"] == ("N/A", "")
        assert shown["Total time"] == (("1.0", "s") if metrics else ("N/A", ""))


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_batch(spark, str(tmp_path / "no.jsonl"), str(tmp_path / "o"), MODEL, Echo, warm=False)


def test_failed_warm_up_aborts(spark, tmp_path):
    class Down:
        def __call__(self, payload):
            raise ConnectionError("down")

    source = tmp_path / "in.jsonl"
    source.write_text(json.dumps(chat("a")))
    with pytest.raises(ConnectionError):
        run_batch(spark, str(source), str(tmp_path / "out"), MODEL, Down)
    assert not (tmp_path / "out").exists()


def test_stream_picks_up_only_new_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    args = (str(inbox), str(tmp_path / "out"), str(tmp_path / "state"), MODEL, Echo)
    for n in range(3):
        (inbox / f"{n}.jsonl").write_text("\n".join(json.dumps(chat(f"f{n} r{i}")) for i in range(4)) + "\n#\n{bad\n")
        stream_requests(spark, *args, retry_delay=0.0).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).select("custom_id").collect()
        assert sorted(r.custom_id for r in rows) == sorted(f"f{m} r{i}" for m in range(n + 1) for i in range(4))


def test_hooks_of_a_processor(spark, tmp_path):
    class Picky(Echo):
        def validate_input(self, payload):
            return payload["messages"][-1]["content"] != "no"

        def format_output(self, answer):
            return {**answer, "usage": {"completion_tokens": 1}}

    exported = str(tmp_path / "list")
    out = run_batch(
        spark, ["no", "yes"], str(tmp_path / "out"), MODEL, Picky, retry_delay=0.0, warm=False,
        input_handler=lambda texts: items(spark, [chat(t) for t in texts]),
        output_handler=lambda stored: sinks.write_results(stored, exported),
    )
    row = out.metrics.first()
    assert (row.failed_requests, row.output_tokens_avg, row.retry_count_total) == (1, 1.0, 0)
    results = json.loads("".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*"))))
    assert [r.get("error") for r in results] == ["input refused by validate_input", None]


def test_finished_slices_are_not_called_again(spark, tmp_path):
    requests = items(spark, [chat(f"text {i}") for i in range(40)])
    out = str(tmp_path / "sliced")
    first = run_batch(spark, requests, out, MODEL, Echo, slices=3, concurrency=4, retry_delay=0.0)
    before = {r.custom_id: str(r.output) for r in first.results.collect()}
    assert len(before) == 40 and first.metrics.first()["total_requests"] == 40

    def broken():
        raise RuntimeError("no calls are left to make")

    again = run_batch(spark, requests, out, MODEL, broken, slices=3, warm=False)
    assert {r.custom_id: str(r.output) for r in again.results.collect()} == before


@pytest.mark.parametrize("again", [1, 2, 8])
def test_run_goes_on_with_any_number_of_slices(spark, tmp_path, again):
    class Down(Exception):
        pass

    def stop(saved):
        if saved == 3:
            raise Down

    # ids repeat: every request is answered, not every id
    requests = items(spark, [chat(f"text {i % 30}") for i in range(40)])
    out = str(tmp_path / "sliced")
    with pytest.raises(Down):
        run_batch(spark, requests, out, MODEL, Echo, slices=5, retry_delay=0.0, on_save_point=stop)
    kept = {(r.custom_id, str(r.output)) for r in spark.read.parquet(f"{out}/save=0", f"{out}/save=1").collect()}
    assert 0 < len(kept) < 40
    # a cut in the middle of a slice leaves files that Spark has not committed
    part = next((tmp_path / "sliced" / "save=2").glob("part-*"))
    (tmp_path / "sliced" / "save=2" / "_SUCCESS").unlink()
    (tmp_path / "sliced" / "save=7").mkdir()
    (tmp_path / "sliced" / "save=7" / part.name).write_bytes(part.read_bytes())
    results = run_batch(spark, requests, out, MODEL, Echo, slices=again, retry_delay=0.0).results
    rows = results.collect()
    assert sorted(r.custom_id for r in rows) == sorted(f"text {i % 30}" for i in range(40))
    assert kept <= {(r.custom_id, str(r.output)) for r in rows}
    assert spark.read.parquet(out).count() == 40


def test_another_run_on_the_same_path_is_refused(spark, tmp_path):
    requests = items(spark, [chat(f"text {i}") for i in range(6)])
    out = str(tmp_path / "sliced")
    run_batch(spark, requests, out, MODEL, Echo, slices=2, retry_delay=0.0)
    for other, options in ((items(spark, [chat("else")]), {}), (requests, {"defaults": {"temperature": 0.1}})):
        with pytest.raises(ValueError, match="another run"):
            run_batch(spark, other, out, MODEL, Echo, slices=2, retry_delay=0.0, **options)


def test_folder_of_parts_reads_like_one_file(spark, tmp_path):
    line = F.concat(F.lit('{"input":{"custom_id":"'), "id", F.lit('"},"metadata":{"retry_count":1},"error":"x,]["}'))
    results = RS.result_from_json(spark.range(0, 500, 1, 6).select(F.col("id").alias("seq"), line.alias("line")))
    for name, write in (
        ("envelope", lambda p: sinks.write_envelope(results, {"run_metrics": {"a": 1}, "gpu_metrics": {"b": {"c": 2}}}, p)),
        ("list", lambda p: sinks.write_results(results, p)),
        ("none", lambda p: sinks.write_envelope(results.limit(0), {"run_metrics": {"a": 1}}, p)),
    ):
        folder = str(tmp_path / name)
        write(folder)
        rows, maps = RS.read_run_file(spark, folder)
        ids = {r[0] for r in rows.select(F.variant_get(F.col("input")["custom_id"], "$", "string")).collect()}
        assert ids == ({str(i) for i in range(500)} if name != "none" else set())
        found = maps.first()
        assert found.run_metrics == ({"a": "1"} if name != "list" else {})
        assert found.gpu_metrics == ({"b": '{"c":2}'} if name == "envelope" else {})
