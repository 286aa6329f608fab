"""JSON items of five shapes to requests.

An item arrives as a VARIANT column ``item`` with its JSON text in ``raw`` (objects and arrays
only). The shapes are tried in a fixed order; a shape's own rules may reject an item, which then
carries an ``error`` and counts as failed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates
from ..functions import variants as V
from .requests import (
    CHAT_URL,
    METHOD,
    id_or_uuid,
    repeated_parameter,
    request_body,
)

# The keys that mark a finished batch request.
BATCH_KEYS = ("method", "url", "body")

# Names the request builder takes itself; an item or parameter repeating one fails.
_BUILDER_NAMES = ("temperature", "max_tokens", "custom_id")

_BATCH, _MESSAGES, _PROMPT, _GENERIC, _SCALAR, _INVALID = (
    "batch", "messages", "prompt", "generic", "scalar", "invalid",
)


def _has(obj: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(obj, key), F.lit(False))


def _get(obj: Column, key: str) -> Column:
    return F.try_element_at(obj, F.lit(key))


def classify_items(items: DataFrame) -> DataFrame:
    """Adds ``obj`` (the item's members, NULL unless an object), ``kind`` and ``item_class``.

    Membership tests look into strings and lists too, so a string containing a marker key, or a
    list holding one, picks a shape it cannot satisfy; numbers, booleans and null fit no shape.
    """
    staged = items.withColumn("obj", V.as_object(F.col("item")))
    staged = staged.withColumn(
        "kind", F.when(F.col("obj").isNotNull(), "object").otherwise(V.kind(F.col("item")))
    )
    obj, kind = F.col("obj"), F.col("kind")
    text = F.when(kind == "string", F.col("item").cast("string"))
    members = F.when(
        kind == "array", F.transform(V.as_list(F.col("item")), lambda v: V.string_or_null(v))
    )

    def mentions(key):
        return F.coalesce(F.contains(text, F.lit(key)), F.array_contains(members, key), F.lit(False))

    all_batch = _has(obj, BATCH_KEYS[0])
    batch_mention = mentions(BATCH_KEYS[0])
    for key in BATCH_KEYS[1:]:
        all_batch &= _has(obj, key)
        batch_mention &= mentions(key)
    return staged.withColumn(
        "item_class",
        F.when(all_batch, _BATCH)
        .when(_has(obj, "messages"), _MESSAGES)
        .when(_has(obj, "prompt"), _PROMPT)
        .when(kind == "object", _GENERIC)
        .when(batch_mention | mentions("messages"), _INVALID)
        .when(kind.isin("string", "array"), _SCALAR)
        .otherwise(_INVALID),
    )


def _item_id(obj: Column, id_field: str | None, use_id: bool) -> Column:
    """id_field, then ``id``, as text; NULL where the item has neither."""
    found = V.value_text(_get(obj, "id")) if use_id else F.lit(None).cast("string")
    if id_field:
        found = F.when(_has(obj, id_field), V.value_text(_get(obj, id_field))).otherwise(found)
    return found


def _conflict(obj: Column, spread: Column, parameters: dict[str, Any]) -> Column:
    """Error text when spread item keys and parameters would name one argument twice."""
    keys = F.map_keys(spread)
    taken = F.array(*[F.lit(k) for k in (*_BUILDER_NAMES, *parameters)])
    clash = F.try_element_at(F.array_intersect(keys, taken), F.lit(1))
    always = [k for k in parameters if k in ("messages", "model", *_BUILDER_NAMES)]
    if always:
        clash = F.coalesce(clash, F.lit(always[0]))
    return F.when(
        clash.isNotNull(),
        F.concat(F.lit("got multiple values for keyword argument '"), clash, F.lit("'")),
    )


def _templated_messages(messages: Column, template: str) -> tuple[Column, Column]:
    """Template applied to the content of every user message (P9); result and error.

    Without user messages nothing changes; entries that are not objects cannot be inspected.
    """
    entries = V.as_list(messages)
    kind = V.kind(messages)

    def content_of(entry):
        value = V.value_text(_get(entry, "content"))
        return F.when(_has(entry, "content"), value).otherwise("")

    def is_user(entry):
        return F.coalesce(V.string_or_null(_get(entry, "role")) == "user", F.lit(False))

    fails = template_fails(template)

    def rewrite(value):
        entry = V.as_object(value)
        out = templates.render(template, {"content": content_of(entry)})
        changed = F.map_concat(
            entry, F.create_map(F.lit("content"), out.text.cast("variant"))
        )
        return F.when(is_user(entry), F.to_variant_object(changed)).otherwise(value)

    has_bad = F.exists(entries, lambda v: V.as_object(v).isNull())
    has_user = F.exists(entries, lambda v: is_user(V.as_object(v)))
    empty = F.to_json(messages).isin('""', "{}", "[]")
    error = (
        F.when(empty, F.lit(None).cast("string"))
        .when(kind != "array", F.concat(F.lit("messages is a "), kind))
        .when(has_bad, F.lit("AttributeError: a message is not an object"))
    )
    if fails is not None:
        error = F.coalesce(error, F.when(~empty & has_user, F.lit(fails)))
        return messages, error
    usable = (kind == "array") & ~has_bad
    if not templates.is_plain(template):
        text = templates.message_formatter(template)(F.when(usable, F.to_json(messages)))
        return F.when(usable, F.parse_json(text)).otherwise(messages), error
    new = F.when(
        usable, F.to_variant_object(F.transform(entries, rewrite))
    ).otherwise(messages)
    return new, error


def template_fails(template: str) -> str | None:
    """Why a ``{content}`` template fails for every row, found on the driver; None if it works."""
    try:
        template.format(content="")
    except Exception as exc:
        return f"{type(exc).__name__}: {exc}"
    return None


def convert_items(
    items: DataFrame,
    model: str | None = None,
    id_field: str | None = None,
    prompt_template: str | None = None,
    api_parameters: dict[str, Any] | None = None,
    exact_text: bool = True,
) -> DataFrame:
    """Items (``seq, source_file, item, raw``) to requests with ``item_class`` and ``error``.

    ``exact_text`` writes an object's or a list's text with the reference layout (spaces after
    separators, ``\\u`` escapes) in Arrow batches; without it the compact JSON text is used and
    the whole conversion stays in the JVM. An ``error`` already on the input is kept.
    """
    parameters = api_parameters or {}
    staged = classify_items(items)
    if "error" not in items.columns:
        staged = staged.withColumn("error", F.lit(None).cast("string"))
    obj, cls, kind = F.col("obj"), F.col("item_class"), F.col("kind")
    needs_text = (cls == _GENERIC) | ((cls == _SCALAR) & (kind == "array"))
    raw = F.when(needs_text, F.coalesce(F.col("raw"), F.to_json("item")))
    if exact_text:
        mode = F.when(cls == _GENERIC, "dumps").otherwise("str")
        raw = V.python_json_text(raw, mode)
    staged = staged.withColumn("_text", raw)
    prompt = _get(obj, "prompt")
    plain = (
        F.when(cls == _PROMPT, V.value_text(prompt))
        .when(needs_text, F.col("_text"))
        .when(cls == _SCALAR, F.col("item").cast("string"))
    )
    staged = staged.withColumn("_plain", plain)
    is_content = cls.isin(_PROMPT, _GENERIC, _SCALAR)
    messages_in = _get(obj, "messages")
    if prompt_template:
        out = templates.render(prompt_template, {"content": F.col("_plain")})
        content, content_error = out.text.cast("variant"), F.when(is_content, out.error)
        item_messages, message_error = _templated_messages(messages_in, prompt_template)
        message_error = F.when(cls == _MESSAGES, message_error)
    else:
        content = F.when(cls == _PROMPT, prompt).otherwise(F.col("_plain").cast("variant"))
        content_error = message_error = F.lit(None).cast("string")
        item_messages = messages_in
    user = F.create_map(F.lit("role"), F.lit("user").cast("variant"), F.lit("content"), content)
    system = F.create_map(
        F.lit("role"), F.lit("system").cast("variant"), F.lit("content"), _get(obj, "system")
    )
    own_messages = F.when(
        (cls == _PROMPT) & _has(obj, "system"), F.to_variant_object(F.array(system, user))
    ).otherwise(F.to_variant_object(F.array(user)))
    messages = F.when(cls == _MESSAGES, item_messages).otherwise(own_messages)

    dropped = F.when(
        cls == _MESSAGES, F.array(*[F.lit(k) for k in ("messages", "model", "id")])
    ).otherwise(F.array(*[F.lit(k) for k in ("prompt", "system", "model", "id")]))
    spreads = cls.isin(_MESSAGES, _PROMPT)
    spread = F.map_filter(obj, lambda k, _: ~F.array_contains(dropped, k))
    if model:
        item_model = V.literal(model)
    else:
        null = V.literal(None)
        item_model = F.when(spreads, F.coalesce(_get(obj, "model"), null)).otherwise(null)
    spread_body = F.map_concat(
        request_body(messages, item_model), spread, V.literal_object(parameters)
    )
    plain_body = request_body(messages, item_model, parameters)

    # finished batch requests: fill what is absent, keep the rest
    batch_body = V.as_object(_get(obj, "body"))
    defaults = V.literal_object({**({"model": model} if model else {}), **parameters})
    filled = F.map_concat(
        batch_body, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(batch_body, k))
    )
    known = F.array(*[F.lit(k) for k in ("custom_id", *BATCH_KEYS, "metadata")])
    # the id column is text; an id of another type is written as it was
    extra = F.map_filter(
        obj, lambda k, v: ~F.array_contains(known, k) | ((k == "custom_id") & (F.schema_of_variant(v) != "STRING"))
    )
    batch_id = F.when(_has(obj, "custom_id"), _get(obj, "custom_id").cast("string")).otherwise(
        F.coalesce(_item_id(obj, id_field, use_id=False), F.uuid())
    )

    repeated = repeated_parameter(parameters)
    error = F.coalesce(
        F.col("error"),
        F.when(cls == _INVALID, F.concat(F.lit("item of unusable type or content: "), kind)),
        F.when((cls == _BATCH) & batch_body.isNull(), "batch item body is not an object"),
        message_error,
        content_error,
        F.when(spreads, _conflict(obj, spread, parameters)),
        F.when(cls.isin(_GENERIC, _SCALAR), F.lit(repeated).cast("string")),
    )
    source = F.create_map(F.lit("source_file"), F.col("source_file").cast("variant"))
    metadata = (
        F.when(cls == _BATCH, V.as_object(_get(obj, "metadata")))
        .when(
            cls == _GENERIC,
            F.map_concat(F.create_map(F.lit("original_item"), F.col("item")), source),
        )
        .otherwise(source)
    )
    built_id = id_or_uuid(F.when(kind == "object", _item_id(obj, id_field, use_id=True)))
    is_batch = cls == _BATCH
    result = staged.select(
        "seq", "item_class", error.alias("error"),
        F.when(is_batch, batch_id).otherwise(built_id).alias("custom_id"),
        F.when(is_batch, V.value_text(_get(obj, "method"))).otherwise(METHOD).alias("method"),
        F.when(is_batch, V.value_text(_get(obj, "url"))).otherwise(CHAT_URL).alias("url"),
        F.when(is_batch, filled).when(spreads, spread_body).otherwise(plain_body).alias("body"),
        metadata.alias("metadata"),
        F.when(is_batch & (F.size(extra) > 0), extra).alias("extra"),
    )
    ok = F.col("error").isNull()
    return result.select(
        "seq", "item_class",
        *[F.when(ok, F.col(c)).alias(c) for c in ("custom_id", "method", "url", "body", "metadata", "extra")],
        "error",
    )
