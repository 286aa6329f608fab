"""Request resolution, the inference map and its results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators import catalog as C
from ..operators import infer as INF
from ..operators import metrics as M
from ..operators import requests as R
from ..operators import resolve as RES
from ..plans.run import run_batch
from ..session import scratch_dir
from ..sources import catalog as CAT
from ..sources import results as RS
from ..streaming import stream_requests
from .conversion import document_files
from .registry import query

MODEL = CAT.ModelSpec("small", name="small", engine="ollama", stop_sequences=("###",))


class LengthModel:
    """Deterministic stand-in for a model: answers with the prompt's length, fails on some."""

    def __call__(self, payload):
        text = payload["messages"][-1]["content"]
        size = len(text)
        if size % 97 == 0:
            raise RuntimeError("server overloaded (503)")
        return {
            "choices": [{"message": {"role": "assistant", "content": f"{size} characters"}}],
            "usage": {"completion_tokens": size % 50},
        }


def _k(name="props"):
    return F.get_json_object(name, "$.k").cast("int")


@query(
    "sampling_params",
    """
    SELECT event_id,
      CASE WHEN k % 21 = 0 THEN 'null' WHEN k % 3 = 0 THEN '0' ELSE '0.2' END AS temperature,
      '0.9' AS top_p,
      CASE WHEN k % 5 = 0 THEN k::VARCHAR ELSE '32' END AS max_tokens,
      CASE WHEN k % 4 = 0 THEN '2' END AS top_k,
      CASE WHEN k % 11 = 0 THEN '["a"]' WHEN k % 13 = 0 THEN 'null' ELSE '["###"]' END AS stop
    FROM (SELECT event_id, (props->>'$.k')::INT AS k FROM events)
    """,
)
def sampling_params(t):
    """Precedence by key presence: an explicit null or 0 in the body stays."""
    k = _k()
    body_text = F.concat(
        F.lit('{"k":'), k.cast("string"),
        F.when(k % 21 == 0, ',"temperature":null').when(k % 3 == 0, ',"temperature":0').otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit(',"max_tokens":'), k.cast("string"))).otherwise(""),
        F.when(k % 4 == 0, ',"top_k":2').otherwise(""),
        F.when(k % 11 == 0, ',"stop":["a"]').when(k % 13 == 0, ',"stop":null').otherwise(""),
        F.lit("}"),
    )
    rows = t.events.select("event_id", V.parse_object(body_text).alias("body"))
    config = {"temperature": 0.7, "top_p": 0.9, "max_tokens": 500}
    params = RES.sampling_parameters(F.col("body"), config, {"max_tokens": 32, "temperature": 0.2})
    stop = RES.stop_sequences(F.col("body"), ("###",))
    rows = rows.withColumn("p", params).withColumn("stop", F.to_json(stop))
    return rows.select(
        "event_id",
        *[F.to_json(F.try_element_at("p", F.lit(n))).alias(n) for n in RES.SAMPLING_KEYS],
        "stop",
    )


_MODEL_KEYS = {
    "1-URGENT": "Llama-3.2-3B-Instruct",
    "2-HIGH": "QwQ-32B",
    "3-MEDIUM": "Qwen3-8B",
    "4-NOT SPECIFIED": "no-such-model",
    "5-LOW": "Phi-3-vision-128k-instruct",
}


@query(
    "model_validate",
    """
    WITH c(model_key, name, hf_name) AS (VALUES
      ('Llama-3.2-3B-Instruct', 'llama3.2:3b', 'meta-llama/Llama-3.2-3B-Instruct'),
      ('QwQ-32B', 'NA', 'Qwen/QwQ-32B'), ('Qwen3-8B', 'qwen3:8b', 'Qwen/Qwen3-8B'),
      ('Phi-3-vision-128k-instruct', 'NA', 'microsoft/Phi-3-vision-128k-instruct')),
    r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'vllm' WHEN 'O' THEN 'ollama' ELSE 'other' END AS engine,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Llama-3.2-3B-Instruct' WHEN '2-HIGH' THEN 'QwQ-32B'
          WHEN '3-MEDIUM' THEN 'Qwen3-8B' WHEN '5-LOW' THEN 'Phi-3-vision-128k-instruct' ELSE 'no-such-model' END AS model_key
      FROM orders),
    j AS (SELECT o_orderkey, engine, model_key, c.name, CASE WHEN engine = 'vllm' THEN hf_name ELSE name END AS chosen
      FROM r LEFT JOIN c USING (model_key)),
    x AS (SELECT *, CASE WHEN name IS NULL THEN 'unknown model' WHEN engine = 'other' THEN 'unknown engine'
        WHEN coalesce(chosen, 'NA') = 'NA' THEN 'not available for engine' END AS reject_reason FROM j)
    SELECT o_orderkey, engine, model_key, reject_reason,
      CASE WHEN reject_reason IS NULL THEN chosen END AS engine_model,
      CASE WHEN reject_reason IS NULL AND chosen <> 'qwen3:8b' THEN
        'JSONL model ''qwen3:8b'' does not match requested model ''' || chosen || '''' END AS mismatch
    FROM x
    """,
)
def model_validate(t):
    keys = F.create_map(*[F.lit(x) for kv in _MODEL_KEYS.items() for x in kv])
    status = F.col("o_orderstatus")
    requests = t.orders.select(
        "o_orderkey",
        F.when(status == "F", "vllm").when(status == "O", "ollama").otherwise("other").alias("engine"),
        F.try_element_at(keys, F.col("o_orderpriority")).alias("model_key"),
    )
    entries = CAT.builtin_entries()
    table = CAT.catalog_table(t.spark, entries)
    joined = C.join_catalog(requests, table, small=len(entries) <= CAT.MAX_BROADCAST_ROWS)
    body = V.literal_object({"model": "qwen3:8b"})
    _, mismatch = RES.model_name(body, F.col("engine_model"))
    return joined.select(
        "o_orderkey", "engine", "model_key", "reject_reason", "engine_model", mismatch.alias("mismatch")
    )


@query(
    "url_routing",
    """
    SELECT event_id,
      CASE event_type WHEN 'view' THEN 'chat' WHEN 'signup' THEN 'chat' WHEN 'click' THEN 'completion' END AS route,
      CASE event_type WHEN 'click' THEN '[{"content":"p' || event_id || '","role":"user"}]'
        WHEN 'view' THEN '[{"content":"m","role":"user"}]' ELSE '[]' END AS messages,
      CASE event_type WHEN 'purchase' THEN 'Unsupported URL: /v1/embeddings' WHEN 'error' THEN 'Unsupported URL: None'
        END AS resolve_error
    FROM events
    """,
)
def url_routing(t):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", '{"url":"/v1/chat/completions","body":{"messages":[{"role":"user","content":"m"}]}}')
        .when(kind == "click", F.concat(F.lit('{"url":"/v1/completions","body":{"prompt":"p'), "event_id", F.lit('"}}')))
        .when(kind == "purchase", '{"url":"/v1/embeddings"}')
        .when(kind == "error", '{"url":null,"body":{}}')
        .otherwise("{}")
    )
    items = t.events.select(F.col("event_id").alias("seq"), F.parse_json(text).alias("item"))
    out = RES.resolve_requests(RES.requests_from_lines(items), MODEL)
    return out.select(
        F.col("seq").alias("event_id"), "route",
        F.to_json(RES.messages(F.col("body"), F.col("route"))).alias("messages"), "resolve_error",
    )


@query(
    "wire_payload",
    """
    SELECT doc_id::VARCHAR AS custom_id,
      json_object('model', 'small', 'messages', json_array(json_object('content', text, 'role', 'user')), 'stream', false,
        'temperature', 0.7, 'top_p', 0.9, 'max_tokens', 200, 'top_k', 5, 'stop', json_array('###'))::VARCHAR AS payload
    FROM documents
    """,
)
def wire_payload(t):
    requests = R.convert_text_files(
        document_files(t), model="small", api_parameters={"max_tokens": 200, "n": 3},
        max_file_size=2**31 - 1, custom_id=F.col("doc_key"),
    )
    return RES.resolve_requests(requests, MODEL, {"top_k": 5}).select("custom_id", "payload")


@query(
    "response_parse",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 3 THEN event_type ELSE '' END AS content,
      CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k ELSE 0 END AS tokens
    FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
    """,
)
def response_parse(t):
    """Answers in the expected shape and in several broken ones."""
    k = _k().cast("string")
    message = F.concat(F.lit('"choices":[{"message":{"content":"'), "event_type", F.lit('"}}]'))
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.concat(F.lit("{"), message, F.lit(',"usage":{"completion_tokens":'), k, F.lit("}}")))
        .when(shape == 1, F.concat(F.lit('{"choices":[],"usage":{"completion_tokens":'), k, F.lit(".7}}")))
        .when(shape == 2, F.concat(F.lit('{"choices":[{"text":"x"}],"usage":{"completion_tokens":"'), k, F.lit('"}}')))
        .when(shape == 3, F.concat(F.lit("{"), message, F.lit(',"usage":null}')))
        .otherwise("{}")
    )
    doc = F.parse_json(text)
    return t.events.select(
        "event_id", INF.response_content(doc).alias("content"),
        INF.completion_tokens(INF.response_usage(doc)).alias("tokens"),
    )


@query(
    "result_rows",
    """
    SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'timed out' WHEN event_id % 4 = 2 THEN '' END AS error,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS latency_ms,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS retry_count,
      CASE WHEN event_id % 4 = 0 THEN (props->>'$.k')::BIGINT ELSE 0 END AS tokens
    FROM events
    """,
)
def result_rows(t):
    """Stored result rows with members missing or of another type, to typed metric inputs."""
    e = F.col("event_id")
    meta = F.concat(
        F.lit('"metadata":{"request_latency_ms":'),
        F.when(e % 3 == 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value").cast("string")),
        F.when(e % 5 == 0, F.lit(',"retry_count":1.5')).otherwise(
            F.concat(F.lit(',"retry_count":'), (e % 5).cast("string"))
        ),
        F.lit("}"),
    )
    text = F.concat(
        F.lit("{"), meta,
        F.when(e % 4 == 0, F.concat(F.lit(',"output":{"usage":{"completion_tokens":'), _k().cast("string"), F.lit("}}")))
        .when(e % 4 == 1, ',"error":"timed out"')
        .when(e % 4 == 2, ',"error":"","output":"text"')
        .otherwise(',"input":{}'),
        F.lit("}"),
    )
    rows = RS.result_from_json(t.events.select("event_id", text.alias("line")))
    return M.metric_inputs(rows).select("event_id", "error", "latency_ms", "retry_count", "tokens")


def _document_requests(t):
    return R.convert_text_files(
        document_files(t), "Count: {content}", model="small", max_file_size=2**31 - 1,
        custom_id=F.col("doc_key"),
    )


_LENGTH_ANSWERS = """
    SELECT doc_id::VARCHAR AS custom_id,
      CASE WHEN size % 97 <> 0 THEN size || ' characters' END AS content,
      CASE WHEN size % 97 = 0 THEN 'server overloaded (503)' END AS error,
      CASE WHEN size % 97 = 0 THEN 2 ELSE 0 END AS retry_count,
      CASE WHEN size % 97 <> 0 THEN size % 50 ELSE 0 END AS tokens
    FROM (SELECT doc_id, length(text) + 7 AS size FROM documents)
    """


def _flat_results(results):
    meta = F.col("metadata")
    return results.select(
        "custom_id",
        F.col("output.choices")[0]["message"]["content"].alias("content"),
        "error",
        F.variant_get(meta["retry_count"], "$", "int").alias("retry_count"),
        INF.completion_tokens(F.col("output.usage")).alias("tokens"),
    )


@query("infer_stub", _LENGTH_ANSWERS)
def infer_stub(t):
    """The inference map over all documents with a deterministic model."""
    resolved = RES.resolve_requests(_document_requests(t), MODEL)
    called = INF.infer(resolved, LengthModel, max_retries=2, retry_delay=0.0)
    return _flat_results(INF.shape_results(called, MODEL.engine_name))


@query(
    "batch_run",
    """
    SELECT count(*) AS total_requests, count(*) FILTER (size % 97 <> 0) AS successful_requests,
      count(*) FILTER (size % 97 = 0) AS failed_requests,
      round(count(*) FILTER (size % 97 <> 0) * 100 / count(*), 2) AS success_rate_pct,
      2 * count(*) FILTER (size % 97 = 0) AS retry_count_total,
      round(count(*) FILTER (size % 97 = 0) * 100.0 / count(*), 2) AS server_errors_pct,
      coalesce(round(avg(size % 50) FILTER (size % 97 <> 0), 2), 0.0) AS output_tokens_avg,
      coalesce(round(quantile_cont((size % 50)::DOUBLE, 0.95) FILTER (size % 97 <> 0), 2), 0.0) AS output_tokens_p95
    FROM (SELECT length(text) + 7 AS size FROM documents)
    """,
)
def batch_run(t):
    """A whole run: results stored once, metrics from the stored table."""
    out = run_batch(
        t.spark, _document_requests(t), scratch_dir(t.spark, "run"), MODEL, LengthModel,
        max_retries=2, retry_delay=0.0,
    )
    return out.metrics.select(
        "total_requests", "successful_requests", "failed_requests", "success_rate_pct",
        "retry_count_total", F.col("error_rate_by_type_pct.server").alias("server_errors_pct"),
        "output_tokens_avg", "output_tokens_p95",
    )


@query("stream_requests", _LENGTH_ANSWERS)
def streamed_requests(t):
    """The same results from JSONL files processed as a stream."""
    work = scratch_dir(t.spark, "stream")
    requests = _document_requests(t)
    requests.select(R.request_json(requests)).write.text(f"{work}/in")
    stream_requests(
        t.spark, f"{work}/in", f"{work}/out", f"{work}/state", MODEL, LengthModel,
        max_retries=2, retry_delay=0.0,
    ).awaitTermination()
    return _flat_results(t.spark.read.parquet(f"{work}/out"))


class _Cut(Exception):
    """Stands for whatever ends a run early."""


@query(
    "resumed_run",
    """
    SELECT doc_id::VARCHAR AS custom_id, count(*) AS answers,
      max(CASE WHEN length(text) % 97 <> 0 THEN length(text) || ' characters' END) AS content
    FROM documents GROUP BY doc_id
    """,
)
def resumed_run(t):
    """A run that is cut after two of six slices and started again with another number of slices."""
    text = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    requests = R.build_requests(t.documents, F.array(text), "small", F.col("doc_id").cast("string"), 0.7, 500, seq="doc_id")
    folder = scratch_dir(t.spark, "resumed")
    options = {"max_retries": 1, "retry_delay": 0.0, "warm": False}

    def cut(saved):
        if saved == 2:
            raise _Cut

    try:
        run_batch(t.spark, requests, folder, MODEL, LengthModel, slices=6, on_save_point=cut, **options)
    except _Cut:
        pass
    results = run_batch(t.spark, requests, folder, MODEL, LengthModel, slices=3, **options).results
    content = F.col("output.choices")[0]["message"]["content"]
    return results.groupBy("custom_id").agg(F.count("*").alias("answers"), F.max(content).alias("content"))
