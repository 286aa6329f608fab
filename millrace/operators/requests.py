"""Request construction from rows, files, images and turn lists.

Every converter maps one input row to one output row and keeps the input's ``seq``. The output
has the request columns ``custom_id, method, url, body, metadata`` and ``error``: a row that
cannot be converted has an error and NULL request columns, it never fails the job.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import templates
from ..functions import text as X
from ..functions import variants as V

METHOD = "POST"
CHAT_URL = "/v1/chat/completions"
COMPLETIONS_URL = "/v1/completions"
REQUEST_COLUMNS = ["custom_id", "method", "url", "body", "metadata"]

# Request defaults.
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 500
DEFAULT_IMAGE_PROMPT = "Describe what you see in this image."

# Names a request's extra parameters must not repeat.
_ENVELOPE_NAMES = ("messages", "model", "custom_id")

# Prompt categories, in sampling order, and their system prompts.
CATEGORIES = (
    "data_analysis", "language", "math", "reasoning", "instruction_following", "coding",
)
CATEGORY_SYSTEM_PROMPTS = {
    "coding": "You are an expert programmer. Provide accurate, well-structured code solutions.",
    "math": "You are a mathematics expert. Think step by step and provide precise solutions.",
    "data_analysis": "You are a data analysis expert. Provide accurate and detailed analysis.",
    "reasoning": "You are an expert at logical reasoning. Think through problems systematically.",
    "instruction_following": "You are a helpful assistant that follows instructions precisely.",
    "language": "You are an expert in language and communication.",
}


def _null(dtype: str = "string") -> Column:
    return F.lit(None).cast(dtype)


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def chat_messages(content: Column, system_prompt: str | None = None) -> Column:
    """User message, after a system message unless that is absent or empty (P5)."""
    user = message("user", content)
    if not system_prompt:
        return F.array(user)
    return F.array(message("system", F.lit(system_prompt)), user)


def turn_messages(turns: Column, category: Column) -> Column:
    """A system message chosen by category, then one user message per turn.

    The six prompts are constants, so the lookup is an expression instead of a join.
    """
    prompts = F.create_map(*[F.lit(x) for kv in CATEGORY_SYSTEM_PROMPTS.items() for x in kv])
    system = F.array(message("system", F.try_element_at(prompts, category)))
    return F.concat(system, F.transform(turns, lambda t: message("user", t)))


def request_body(
    messages: Column,
    model: str | Column | None,
    parameters: dict[str, Any] | None = None,
) -> Column:
    """Body map (P1, P16): ``model`` is present even when null, parameters override defaults.

    ``messages`` is an array of structs or already a variant.
    """
    settings = {
        "temperature": DEFAULT_TEMPERATURE,
        "max_tokens": DEFAULT_MAX_TOKENS,
        **(parameters or {}),
    }
    model_value = model if isinstance(model, Column) else V.literal(model)
    return F.create_map(
        F.lit("model"), model_value,
        F.lit("messages"), messages,
        *[c for k, v in settings.items() for c in (F.lit(k), V.literal(v))],
    )


def repeated_parameter(parameters: dict[str, Any] | None) -> str | None:
    """Error text when extra parameters repeat an envelope argument."""
    for name in _ENVELOPE_NAMES:
        if name in (parameters or {}):
            return f"got multiple values for keyword argument '{name}'"
    return None


def id_or_uuid(value: Column | None) -> Column:
    """The id, or a new UUID where it is missing or empty.

    ``uuid()`` differs per evaluation: write the requests once before using them twice.
    """
    if value is None:
        return F.uuid()
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.uuid())


def build_requests(
    rows: DataFrame, messages: str | Column, model: str | None = None,
    custom_id: str | Column | None = None, temperature: float = DEFAULT_TEMPERATURE,
    max_tokens: int = DEFAULT_MAX_TOKENS, metadata: Column | None = None, seq: str = "seq",
    **parameters: Any,
) -> DataFrame:
    """Request rows from a message-list column (P1); further parameters go into the body."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    key = F.col(custom_id).cast("string") if isinstance(custom_id, str) else custom_id
    settings = {"temperature": temperature, "max_tokens": max_tokens, **parameters}
    return rows.select(
        F.col(seq).alias("seq"),
        id_or_uuid(key).alias("custom_id"),
        F.lit(METHOD).alias("method"),
        F.lit(CHAT_URL).alias("url"),
        request_body(F.to_variant_object(messages), model, settings).alias("body"),
        (_null(V.OBJECT) if metadata is None else metadata).alias("metadata"),
    )


def _finish(df: DataFrame, keep: list[str], custom_id, body, metadata, error: Column) -> DataFrame:
    ok = F.col("error").isNull()
    staged = df.select(
        *keep, error.alias("error"), custom_id.alias("_id"), body.alias("_body"), metadata.alias("_meta")
    )
    return staged.select(
        *keep,
        F.when(ok, F.col("_id")).alias("custom_id"),
        F.when(ok, METHOD).alias("method"),
        F.when(ok, CHAT_URL).alias("url"),
        F.when(ok, F.col("_body")).alias("body"),
        F.when(ok, F.col("_meta")).alias("metadata"),
        "error",
    )


def _fields_of(dtype: T.StructType, row: str) -> dict[str, tuple[Column, T.DataType]]:
    return {f.name: (F.col(row).getField(f.name), f.dataType) for f in dtype.fields}


def convert_rows(
    rows: DataFrame,
    prompt_template: str | None = None,
    prompt_column: str | None = None,
    system_prompt: str | None = None,
    model: str | None = None,
    id_column: str | None = None,
    api_parameters: dict[str, Any] | None = None,
    null_text: str = "nan",
) -> DataFrame:
    """Table rows to requests.

    ``rows`` has ``seq, source_file`` and the cells in a struct column ``row``. A template wins
    over a prompt column; a missing cell prints as ``null_text``.
    """
    if not prompt_template and not prompt_column:
        raise ValueError("Either prompt_template or prompt_column must be provided")
    cells = _fields_of(rows.schema["row"].dataType, "row")
    texts = {n: X.scalar_text(c, t, null_text) for n, (c, t) in cells.items()}
    error = _null()
    if prompt_template and "template" in cells:
        content, error = _null(), F.lit("got multiple values for argument 'template'")
    elif prompt_template:
        out = templates.render(prompt_template, texts, {n: c for n, (c, _) in cells.items()}, "")
        content, error = out.text, out.error
    elif prompt_column not in cells:
        content, error = _null(), F.lit(f"Prompt column '{prompt_column}' not found in row")
    else:
        content = texts[prompt_column]
    if (repeated := repeated_parameter(api_parameters)) is not None:
        error = F.coalesce(error, F.lit(repeated))
    row_id = texts[id_column] if id_column in cells else None
    staged = rows.select("seq", "source_file", "row", content.alias("_content"), error.alias("_error"))
    metadata = F.create_map(
        F.lit("csv_row"), F.to_variant_object(F.col("row")),
        F.lit("source_file"), F.col("source_file").cast("variant"),
    )
    messages = F.to_variant_object(chat_messages(F.col("_content"), system_prompt))
    body = request_body(messages, model, api_parameters)
    return _finish(staged, ["seq"], id_or_uuid(row_id), body, metadata, F.col("_error"))


def convert_text_files(
    files: DataFrame,
    prompt_template: str | None = None,
    system_prompt: str | None = None,
    model: str | None = None,
    api_parameters: dict[str, Any] | None = None,
    encoding: str = "utf-8",
    max_file_size: int = 1024 * 1024,
    custom_id: Column | None = None,
) -> DataFrame:
    """Text files (``path, length, content``) to requests.

    ``content`` may be binary or already text. A file over the limit is a failed row, and so is one with an ``error`` of its source.
    """
    is_text = isinstance(files.schema["content"].dataType, T.StringType)
    content = F.col("content") if is_text else X.decode_text(F.col("content"), encoding)
    too_large = F.when(
        F.col("length") > max_file_size,
        F.format_string(
            "File %s exceeds size limit: %d > %d", "path", "length", F.lit(max_file_size)
        ),
    )
    if "error" in files.columns:
        too_large = F.coalesce(too_large, F.col("error"))
    staged = files.select(
        F.col("path"), F.col("length"), content.alias("_text"), too_large.alias("_large"),
        id_or_uuid(custom_id).alias("_custom"),
    )
    if prompt_template:
        out = templates.render(prompt_template, {"content": F.col("_text")})
        text, error = out.text, F.coalesce(F.col("_large"), out.error)
    else:
        text, error = F.col("_text"), F.col("_large")
    if (repeated := repeated_parameter(api_parameters)) is not None:
        error = F.coalesce(error, F.lit(repeated))
    messages = F.to_variant_object(chat_messages(text, system_prompt))
    metadata = F.create_map(
        F.lit("source_file"), F.col("path").cast("variant"),
        F.lit("file_size"), F.col("length").cast("variant"),
        F.lit("file_extension"), P.suffix(F.col("path")).cast("variant"),
    )
    staged = staged.withColumn("seq", F.struct("path"))
    body = request_body(messages, model, api_parameters)
    return _finish(staged, ["seq"], F.col("_custom"), body, metadata, error)


def image_messages(prompt: Column, path: Column, content: Column, system_prompt: str | None) -> Column:
    """Text part and data-URL part as a variant message list."""
    url = F.concat(F.lit("data:"), P.mime_type(path), F.lit(";base64,"), F.base64(content))
    parts = F.array(
        F.to_variant_object(F.struct(F.lit("text").alias("type"), prompt.alias("text"))),
        F.to_variant_object(
            F.struct(
                F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")
            )
        ),
    )
    user = F.create_map(
        F.lit("role"), F.lit("user").cast("variant"), F.lit("content"), F.to_variant_object(parts)
    )
    if not system_prompt:
        return F.to_variant_object(F.array(user))
    system = F.create_map(
        F.lit("role"), F.lit("system").cast("variant"),
        F.lit("content"), F.lit(system_prompt).cast("variant"),
    )
    return F.to_variant_object(F.array(system, user))


def with_prompts(
    files: DataFrame,
    prompts: dict[str, str] | DataFrame | None,
    default: str,
    path: str = "path",
) -> DataFrame:
    """Adds ``prompt``: by full path, else by file name, else the default.

    Prompts come as a small dict, or as a table ``key, prompt`` of any size. The table joins are
    not hinted: adaptive execution broadcasts a table it has measured to be small, and splits
    skewed file names otherwise.
    """
    if prompts is None or (isinstance(prompts, dict) and not prompts):
        return files.withColumn("prompt", F.lit(default))
    name = P.basename(F.col(path))
    if isinstance(prompts, dict):
        prompts = files.sparkSession.createDataFrame(list(prompts.items()), "key string, prompt string")
    unique = prompts.groupBy("key").agg(F.max("prompt").alias("prompt"))
    by_path = unique.select(F.col("key").alias(path), F.col("prompt").alias("_by_path"))
    by_name = unique.select(F.col("key").alias("_name"), F.col("prompt").alias("_by_name"))
    return (
        files.withColumn("_name", name)
        .join(by_path, path, "left")
        .join(by_name, "_name", "left")
        .withColumn("prompt", F.coalesce("_by_path", "_by_name", F.lit(default)))
        .drop("_name", "_by_path", "_by_name")
    )


def convert_images(
    images: DataFrame,
    root: str,
    prompt_template: str | None = None,
    prompts: dict[str, str] | DataFrame | None = None,
    system_prompt: str | None = None,
    model: str | None = None,
    max_image_size: int = 25 * 1024 * 1024,
) -> DataFrame:
    """Images (``path, length, content``) to vision requests.

    Adds ``status``: converted, skipped_too_large, or failed where the source has an ``error``, which is then the row's.
    The prompt is used as it is, braces included.
    """
    path = F.col("path")
    too_large = F.col("length") > max_image_size
    staged = with_prompts(images, prompts, prompt_template or DEFAULT_IMAGE_PROMPT).withColumn(
        "seq", F.struct("path")
    )
    messages = image_messages(F.col("prompt"), path, F.col("content"), system_prompt)
    metadata = F.create_map(
        F.lit("filepath"), P.relative_to(path, root).cast("variant"),
        F.lit("filename"), P.basename(path).cast("variant"),
        F.lit("size"), F.col("length").cast("variant"),
    )
    unreadable = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    staged = staged.withColumn("_unreadable", unreadable)
    error = F.when(
        too_large,
        F.format_string(
            "image too large (%d bytes > max_image_size %d)", "length", F.lit(max_image_size)
        ),
    ).otherwise(F.col("_unreadable"))
    out = _finish(
        staged, ["seq", "path", "length", "_unreadable"], id_or_uuid(P.stem(path)),
        request_body(messages, model), metadata, error,
    )
    status = F.when(F.col("error").isNull(), "converted").when(F.col("_unreadable").isNotNull(), "failed")
    return out.withColumn("status", status.otherwise("skipped_too_large")).drop("_unreadable")


def request_json(df: DataFrame, name: str = "line") -> Column:
    """A request row as one JSON object; metadata is left out when absent.

    An ``extra`` column holds further top-level keys of requests passed through unchanged.
    """
    envelope = F.create_map(
        F.lit("custom_id"), F.col("custom_id").cast("variant"),
        F.lit("method"), F.col("method").cast("variant"),
        F.lit("url"), F.col("url").cast("variant"),
        F.lit("body"), F.to_variant_object(F.col("body")),
    )
    meta = F.when(
        F.col("metadata").isNotNull(),
        F.create_map(F.lit("metadata"), F.to_variant_object(F.col("metadata"))),
    ).otherwise(F.from_json(F.lit("{}"), V.OBJECT))
    parts = [envelope, meta]
    if "extra" in df.columns:
        parts.append(F.coalesce(F.col("extra"), F.from_json(F.lit("{}"), V.OBJECT)))
    return F.to_json(F.map_concat(*parts)).alias(name)
