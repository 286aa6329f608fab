"""The inference map (I1-I4) and result shaping.

Only the payload text enters Python: an iterator-style Arrow UDF calls the user's completion
function row by row, and everything before and after it is native. A result evaluated twice calls
the model twice, so write results once and read them back (``plans.run_batch`` does).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V

CALL_SCHEMA = "response string, error string, retry_count int, latency_ms double, finished_at timestamp"


class Completer(Protocol):
    """What a partition opens, calls and closes (I4); a plain function works as well.

    It may also have ``close()``, ``validate_input(payload) -> bool`` (a refused payload fails
    without a call) and ``format_output(answer)``, applied to each answer.
    """

    def __call__(self, payload: dict[str, Any]) -> dict[str, Any] | str: ...


CompleterFactory = Callable[[], Completer]


def _answer(complete, request: dict[str, Any]) -> str:
    """One call; the JSON text of its answer, which must be an object."""
    answer = complete(request)
    shape = getattr(complete, "format_output", None)
    answer = answer if shape is None else shape(answer)
    text = answer if isinstance(answer, str) else json.dumps(answer, allow_nan=False)
    if not isinstance(json.loads(text), dict):
        raise ValueError("the answer is not a JSON object")
    return text


def _call(complete, payload: str, max_retries: int, retry_delay: float):
    """One request: every failure is retried until the attempts are used up.

    An answer that is no JSON object, or cannot be written as JSON, is a failure like any other.
    """
    started = time.perf_counter()
    request = json.loads(payload)
    retries, text = 0, None
    accepts = getattr(complete, "validate_input", None)
    try:
        refused = None if accepts is None or accepts(request) else "input refused by validate_input"
    except Exception as exc:  # the row records it, the job goes on
        refused = f"validate_input failed: {exc}"
    if refused is not None:
        return None, refused, 0, 0.0, pd.Timestamp.now("UTC")
    while True:
        try:
            text, error = _answer(complete, request), None
            break
        except Exception as exc:
            error = str(exc) or type(exc).__name__
        if retries == max_retries:
            break
        retries += 1
        time.sleep(retry_delay)
    latency = round((time.perf_counter() - started) * 1000.0, 2)
    return text, error, retries, latency, pd.Timestamp.now("UTC")


def _caller(factory: CompleterFactory, max_retries: int, retry_delay: float, concurrency: int):
    @F.pandas_udf(CALL_SCHEMA)
    def call(payloads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        complete = factory()
        names = ["response", "error", "retry_count", "latency_ms", "finished_at"]

        def one(text):
            if text is None:
                return (None, None, None, None, pd.NaT)
            return _call(complete, text, max_retries, retry_delay)

        try:
            with ThreadPoolExecutor(concurrency) as pool:
                for batch in payloads:
                    out = pd.DataFrame(list(pool.map(one, batch)), columns=names)  # in the batch's order
                    out["retry_count"] = out["retry_count"].astype("Int32")
                    out["finished_at"] = pd.to_datetime(out["finished_at"], utc=True)
                    yield out
        finally:
            close = getattr(complete, "close", None)
            if close is not None:
                close()

    return call.asNondeterministic()


def warm_up(factory: CompleterFactory, model: str) -> None:
    """One call on the driver before a run (I3); its failure aborts the run."""
    complete = factory()
    try:
        complete(
            {
                "model": model,
                "messages": [{"role": "user", "content": "Hello, world!"}],
                "max_tokens": 5,
                "stream": False,
            }
        )
    finally:
        close = getattr(complete, "close", None)
        if close is not None:
            close()


def infer(
    resolved: DataFrame,
    factory: CompleterFactory,
    max_retries: int = 3,
    retry_delay: float = 1.0,
    partitions: int | None = None, concurrency: int = 1,
) -> DataFrame:
    """Adds ``response, error, retry_count, latency_ms, finished_at`` to resolved requests.

    A request that could not be resolved never reaches the model; it fails with all its retries
    counted, since no retry could have helped. ``partitions`` spreads a skewed input over that many
    callers, and each keeps ``concurrency`` calls under way; the completer must then be thread-safe.
    """
    if partitions:
        resolved = resolved.repartition(partitions)
    called = resolved.withColumn(
        "_call", _caller(factory, max_retries, retry_delay, concurrency)(F.col("payload"))
    )
    bad = F.col("resolve_error").isNotNull()
    return called.select(
        *resolved.columns,
        F.col("_call.response").alias("response"),
        F.coalesce("resolve_error", "_call.error").alias("error"),
        F.when(bad, F.lit(max_retries)).otherwise(F.col("_call.retry_count")).alias("retry_count"),
        F.when(bad, F.lit(0.0)).otherwise(F.col("_call.latency_ms")).alias("latency_ms"),
        F.coalesce(F.col("_call.finished_at"), F.current_timestamp()).alias("finished_at"),
    )


def response_content(response: Column) -> Column:
    """Answer text of a response document; an unexpected shape gives an empty text."""
    content = F.try_variant_get(response, "$.choices[0].message.content", "variant")
    return F.when(content.isNull(), "").otherwise(
        F.when(~F.is_variant_null(content), content.cast("string"))
    )


def response_usage(response: Column) -> Column:
    usage = F.try_variant_get(response, "$.usage", "variant")
    return F.when(V.truthy(usage), usage).otherwise(F.parse_json(F.lit("{}")))


def completion_tokens(usage: Column) -> Column:
    """Completion tokens of a usage object (P24): a number, cut to whole tokens, else 0."""
    value = V.number_or_null(F.try_variant_get(usage, "$.completion_tokens", "variant"))
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return F.coalesce(whole.cast("bigint"), F.lit(0).cast("bigint"))


def output_struct(route: Column, model: Column, content: Column, usage: Column, finished: Column) -> Column:
    """Chat or text completion output (P20, P21); unused members are NULL and drop out of JSON."""
    chat = route == "chat"
    choice = F.struct(
        F.when(~chat, content).alias("text"),
        F.lit(0).alias("index"),
        F.when(
            chat, F.struct(F.lit("assistant").alias("role"), content.alias("content"))
        ).alias("message"),
        F.lit("stop").alias("finish_reason"),
    )
    return F.struct(
        F.uuid().alias("id"),
        F.when(chat, "chat.completion").otherwise("text_completion").alias("object"),
        F.unix_timestamp(finished).alias("created"),
        model.alias("model"),
        F.array(choice).alias("choices"),
        usage.alias("usage"),
    )


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


#: Number of a stored request; results carry it, so that a run can tell which requests it has answered.
REQUEST_KEY = "_request"


def shape_results(called: DataFrame, run_model: str) -> DataFrame:
    """Result rows ``seq, custom_id, input, output, error, metadata``.

    The request's own metadata is laid over the base metadata and wins, also over ``model``,
    ``retry_count`` and ``request_latency_ms``.
    """
    ok = F.col("error").isNull()
    staged = called.withColumn("_doc", F.try_parse_json("response"))
    base = F.create_map(
        F.lit("model"), F.lit(run_model).cast("variant"),
        F.lit("timestamp"), iso_timestamp(F.col("finished_at")).cast("variant"),
        F.lit("request_latency_ms"), F.col("latency_ms").cast("variant"),
        F.lit("retry_count"), F.col("retry_count").cast("variant"),
        F.lit("method"), F.col("method").cast("variant"),
        F.lit("url"), F.col("url").cast("variant"),
    )
    empty = F.from_json(F.lit("{}"), V.OBJECT)
    flag = F.when(ok, empty).otherwise(F.create_map(F.lit("error"), F.lit(True).cast("variant")))
    if "input" in called.columns:
        request = F.col("input")
    else:
        request = F.map_concat(
            F.create_map(
                F.lit("custom_id"), F.col("custom_id").cast("variant"),
                F.lit("method"), F.col("method").cast("variant"),
                F.lit("url"), F.col("url").cast("variant"),
                F.lit("body"), F.to_variant_object("body"),
            ),
            F.when(
                F.col("metadata").isNotNull(),
                F.create_map(F.lit("metadata"), F.to_variant_object("metadata")),
            ).otherwise(empty),
        )
    output = output_struct(
        F.col("route"), F.col("model"), response_content(F.col("_doc")),
        response_usage(F.col("_doc")), F.col("finished_at"),
    )
    return staged.select(
        *[c for c in ("seq", REQUEST_KEY) if c in called.columns],
        "custom_id",
        request.alias("input"),
        F.when(ok, output).alias("output"),
        "error",
        F.map_concat(base, flag, F.coalesce("metadata", empty)).alias("metadata"),
    )


def result_json(name: str = "line") -> Column:
    """A result row as JSON: input and metadata always, output and error only when set."""
    return F.to_json(F.struct("input", "metadata", "output", "error")).alias(name)
