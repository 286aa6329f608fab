"""From request rows to the call each one makes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..sources.catalog import ModelSpec
from .requests import CHAT_URL, COMPLETIONS_URL, METHOD

# Sampling parameters a run may set, in payload order.
SAMPLING_KEYS = ("temperature", "top_p", "max_tokens", "top_k")


def requests_from_lines(items: DataFrame) -> DataFrame:
    """Parsed JSONL items (VARIANT ``item``) as request rows.

    A missing url means chat; a null url is a url of its own (and unsupported). A missing body is
    empty, a body of another type is NULL and fails later. ``input`` keeps the whole request for the
    result row.
    """
    staged = items.withColumn("input", V.as_object(F.col("item")))
    obj = F.col("input")

    def member(key):
        return F.try_element_at(obj, F.lit(key))

    def text(key, default):
        return F.when(F.map_contains_key(obj, key), V.value_text(member(key))).otherwise(default)

    empty = F.from_json(F.lit("{}"), V.OBJECT)
    return staged.select(
        *[c for c in ("seq", "source_file") if c in items.columns],
        F.coalesce(V.value_text(member("custom_id")), F.uuid()).alias("custom_id"),
        text("method", METHOD).alias("method"),
        text("url", CHAT_URL).alias("url"),
        F.when(F.map_contains_key(obj, "body"), V.as_object(member("body"))).otherwise(empty).alias("body"),
        V.as_object(member("metadata")).alias("metadata"),
        "input",
    )


def route(url: Column) -> Column:
    """chat | completion, NULL for an unsupported url."""
    return F.when(F.coalesce(url, F.lit(CHAT_URL)) == CHAT_URL, "chat").when(
        url == COMPLETIONS_URL, "completion"
    )


def _body(key: str, body: Column) -> Column:
    return F.try_element_at(body, F.lit(key))


def model_name(body: Column, configured: str | Column) -> tuple[Column, Column]:
    """Model of a request and the error if it names another one than configured."""
    configured = F.lit(configured) if isinstance(configured, str) else configured
    own = F.when(V.truthy(_body("model", body)), V.value_text(_body("model", body)))
    error = F.when(
        own != configured,
        F.concat(
            F.lit("JSONL model '"), own, F.lit("' does not match requested model '"),
            configured, F.lit("'"),
        ),
    )
    return F.coalesce(own, configured), error


def sampling_parameters(
    body: Column, config: dict[str, Any], defaults: dict[str, Any] | None = None
) -> Column:
    """Resolved parameters as a map (P17): body by key presence, then run defaults, then config.

    Later maps win, so one ``map_concat`` states the whole precedence. ``top_k`` has no config
    value and is absent unless the body or the run sets it.
    """
    base = {k: v for k, v in config.items() if k in SAMPLING_KEYS[:3] and v is not None}
    run = {k: v for k, v in (defaults or {}).items() if k in SAMPLING_KEYS and v is not None}
    ordered = {k: {**base, **run}[k] for k in SAMPLING_KEYS if k in {**base, **run}}
    keys = F.array(*[F.lit(k) for k in SAMPLING_KEYS])
    own = F.map_filter(body, lambda k, _: F.array_contains(keys, k))
    return F.map_concat(V.literal_object(ordered), own)


def stop_sequences(body: Column, config_stop: tuple[str, ...] | None) -> Column:
    """``stop`` of the body when present, null or not, else the model's own."""
    fallback = V.literal(None if config_stop is None else list(config_stop))
    return F.when(F.map_contains_key(body, "stop"), _body("stop", body)).otherwise(fallback)


def messages(body: Column, route_col: Column) -> Column:
    """Messages of a chat body; a completion's prompt becomes one user message."""
    chat = F.when(F.map_contains_key(body, "messages"), _body("messages", body)).otherwise(
        F.parse_json(F.lit("[]"))
    )
    prompt = F.when(F.map_contains_key(body, "prompt"), _body("prompt", body)).otherwise(
        F.lit("").cast("variant")
    )
    user = F.create_map(F.lit("role"), F.lit("user").cast("variant"), F.lit("content"), prompt)
    return F.when(route_col == "completion", F.to_variant_object(F.array(user))).otherwise(chat)


def payload(model: Column, msgs: Column, params: Column, stop: Column) -> Column:
    """The wire payload as JSON text (P22): only these members travel, an empty stop does not."""
    head = F.create_map(
        F.lit("model"), model.cast("variant"),
        F.lit("messages"), msgs,
        F.lit("stream"), F.lit(False).cast("variant"),
    )
    tail = F.when(V.truthy(stop), F.create_map(F.lit("stop"), stop)).otherwise(
        F.from_json(F.lit("{}"), V.OBJECT)
    )
    return F.to_json(F.map_concat(head, params, tail))


def resolve_requests(
    requests: DataFrame, model: ModelSpec, defaults: dict[str, Any] | None = None
) -> DataFrame:
    """Adds ``route, model, payload, resolve_error`` to request rows; all native expressions.

    Rows a converter could not convert (its ``error`` is set) are no requests and are left out.
    """
    if "error" in requests.columns:
        requests = requests.where(F.col("error").isNull()).drop("error")
    body = F.col("body")
    name, mismatch = model_name(body, model.engine_name)
    config = {"temperature": model.temperature, "top_p": model.top_p, "max_tokens": model.max_tokens}
    staged = requests.withColumn("route", route(F.col("url"))).withColumn("model", name)
    unsupported = F.when(
        F.col("route").isNull(), F.concat(F.lit("Unsupported URL: "), F.coalesce("url", F.lit("None")))
    )
    no_body = F.when(body.isNull(), "body is not an object")
    # a line that holds another JSON value is no request; the row stays and counts as failed
    no_object = F.when(F.col("input").isNull(), "request is not an object") if "input" in requests.columns else F.lit(None)
    staged = staged.withColumn("resolve_error", F.coalesce(no_object, unsupported, no_body, mismatch))
    call = payload(
        F.col("model"),
        messages(body, F.col("route")),
        sampling_parameters(body, config, defaults),
        stop_sequences(body, model.stop_sequences),
    )
    return staged.withColumn("payload", F.when(F.col("resolve_error").isNull(), call))
