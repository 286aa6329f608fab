"""Round trips through real files, and the faults a run has to record."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import functions as F

from .. import sinks
from ..functions import text as TX
from ..operators import infer as INF
from ..operators import metrics as M
from ..operators import ranking
from ..operators import requests as R
from ..operators import resolve as RES
from ..session import scratch_dir
from ..sources import csv_rows
from ..sources import files as FI
from ..sources import jsonl
from ..sources import results as RS
from ..sources import tree
from .registry import query
from .serving import MODEL


#: Documents in one of the files that are written to be cut again.
PART_ROWS = 10_000


class FaultyModel:
    """Answers by the prompt's first character: not JSON, not writable as JSON, or its length."""

    def __call__(self, payload):
        text = payload["messages"][-1]["content"]
        if text.startswith("1"):
            return "Hello there"
        if text.startswith("2"):
            return {"choices": {1, 2}}
        return {
            "choices": [{"message": {"role": "assistant", "content": f"{len(text)} characters"}}],
            "usage": {"completion_tokens": 1},
        }


@query(
    "infer_faults",
    """
    SELECT doc_id,
      CASE WHEN doc_id % 5 IN (3, 4) THEN (length(text) + 2) || ' characters' END AS content,
      CASE doc_id % 5 WHEN 0 THEN 'request is not an object'
        WHEN 1 THEN 'Expecting value: line 1 column 1 (char 0)'
        WHEN 2 THEN 'Object of type set is not JSON serializable' END AS error,
      CASE doc_id % 5 WHEN 3 THEN 0 WHEN 4 THEN 7 ELSE 2 END AS retry_count,
      CASE doc_id % 5 WHEN 3 THEN 'text_completion' WHEN 4 THEN 'chat.completion' END AS object
    FROM documents
    """,
)
def infer_faults(t):
    """Lines that are no requests, answers that are no JSON, completions, and overriding metadata."""
    kind, text = F.col("doc_id") % 5, F.concat((F.col("doc_id") % 5).cast("string"), F.lit(":"), "text")
    chat = F.struct(F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"))
    request = F.when(
        kind == 3,
        F.to_json(F.struct(F.lit(R.COMPLETIONS_URL).alias("url"), F.struct(text.alias("prompt")).alias("body"))),
    ).otherwise(
        F.to_json(F.struct(chat.alias("body"), F.when(kind == 4, F.struct(F.lit(7).alias("retry_count"))).alias("metadata")))
    )
    line = F.when(kind == 0, F.to_json(F.array("text"))).otherwise(request)
    items = t.documents.select(F.col("doc_id").alias("seq"), F.parse_json(line).alias("item"))
    resolved = RES.resolve_requests(RES.requests_from_lines(items), MODEL)
    called = INF.infer(resolved, FaultyModel, max_retries=2, retry_delay=0.0, concurrency=4)
    choice = F.col("output.choices")[0]
    return INF.shape_results(called, MODEL.engine_name).select(
        F.col("seq").alias("doc_id"),
        F.coalesce(choice["message"]["content"], choice["text"]).alias("content"),
        "error",
        F.variant_get(F.col("metadata")["retry_count"], "$", "int").alias("retry_count"),
        F.col("output.object").alias("object"),
    )


@query(
    "envelope_roundtrip",
    """
    SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'timed out' END AS error,
      value AS latency_ms, event_id % 5 AS retry_count,
      CASE WHEN event_id % 4 = 0 THEN (props->>'$.k')::BIGINT ELSE 0 END AS tokens,
      '2.5' AS elapsed
    FROM events
    """,
)
def envelope_roundtrip(t):
    """Results through an envelope of several parts and back, with its metric maps."""
    e, number = F.col("event_id"), F.get_json_object("props", "$.k")
    tail = F.when(
        e % 4 == 0, F.concat(F.lit(',"output":{"usage":{"completion_tokens":'), number, F.lit("}}"))
    ).when(e % 4 == 1, ',"error":"timed out"').otherwise("")
    line = F.concat(
        F.lit('{"input":{"custom_id":"'), e.cast("string"), F.lit('"},"metadata":{"request_latency_ms":'),
        F.col("value").cast("string"), F.lit(',"retry_count":'), (e % 5).cast("string"), F.lit("}"), tail, F.lit("}"),
    )
    results = RS.result_from_json(t.events.select(e.alias("seq"), line.alias("line")))
    folder = scratch_dir(t.spark, "envelope")
    sinks.write_envelope(results, {"run_metrics": {"elapsed_sec": 2.5}}, folder)
    rows, maps = RS.read_run_file(t.spark, folder)
    elapsed = maps.select(F.col("run_metrics")["elapsed_sec"]).first()[0]  # one row per envelope
    named = M.metric_inputs(rows.withColumn("event_id", F.variant_get(F.col("input")["custom_id"], "$", "bigint")))
    return named.select(
        "event_id", "error", "latency_ms", "retry_count", "tokens", F.lit(elapsed).alias("elapsed")
    )


def _part_files(t) -> int:
    """How many files the documents are written to: four, and one more for each ``PART_ROWS`` rows beyond."""
    return max(4, -(-t.documents.count() // PART_ROWS))


@query(
    "csv_documents",
    "SELECT doc_id::VARCHAR AS custom_id, text AS content, source FROM documents",
)
def csv_documents(t):
    """Texts with quotes and line breaks through CSV files into requests."""
    folder = scratch_dir(t.spark, "csv")
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t.documents.write.csv(folder, header=True, escape='"', quoteAll=True, **exact)
    rows = csv_rows.read_csv_rows(t.spark, folder, t.documents.schema, **exact)
    out = R.convert_rows(rows, prompt_column="text", model="small", id_column="doc_id")
    message = F.variant_get(F.try_element_at("body", F.lit("messages")), "$[0].content", "string")
    source = F.variant_get(F.try_element_at("metadata", F.lit("csv_row")), "$.source", "string")
    return out.select("custom_id", message.alias("content"), source.alias("source"))


@query(
    "large_csv",
    "SELECT doc_id, source, text, n_chars FROM documents",
)
def large_csv(t):
    """Texts with quotes and line breaks in CSV files that are larger than a split."""
    folder = scratch_dir(t.spark, "csv")
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    columns = t.documents.select("doc_id", "source", F.concat(F.lit('"'), "text", F.lit('",\n"')).alias("text"), "n_chars")
    columns.repartition(_part_files(t), "doc_id").write.csv(folder, header=True, escape='"', **exact)
    rows = csv_rows.read_csv_rows(t.spark, folder, columns.schema, split_over=1 << 14, range_bytes=1 << 19, **exact)
    text = F.expr("substr(row.text, 2, length(row.text) - 5)")
    return rows.select("row.doc_id", "row.source", text.alias("text"), "row.n_chars")


@query(
    "text_folder",
    """
    SELECT item_id::VARCHAR AS custom_id, strlen(text) + 1 AS length, 'Count: ' || text || chr(10) AS content
    FROM benchmark
    """,
)
def text_folder(t):
    """One text file per item, found by pattern, read whole and converted."""
    folder = scratch_dir(t.spark, "texts")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(folder)
    files = FI.read_text_files(t.spark, folder, "*.txt", extensions=["txt"], exclude_patterns=["*.tmp"])
    named = files.withColumn("item", F.regexp_extract("path", "item_id=([0-9]+)", 1))
    read = named.withColumn("content", TX.decode_text(F.col("content")))
    out = R.convert_text_files(read, "Count: {content}", model="small", custom_id=F.col("item"))
    message = F.variant_get(F.try_element_at("body", F.lit("messages")), "$[0].content", "string")
    return out.select(
        "custom_id", (F.octet_length(message).cast("bigint") - len("Count: ")).alias("length"), message.alias("content")
    )


def _write_files(files, folder: str) -> None:
    """One file per row ``name, content``, written by the tasks; names may hold one folder."""

    def write(rows):
        local = tree.is_local(folder)
        system, base = (afs.LocalFileSystem(), local) if local else afs.FileSystem.from_uri(folder)
        system.create_dir(base)
        for row in rows:
            if "/" in row.name:
                system.create_dir(f"{base}/{row.name.rsplit('/', 1)[0]}")
            with system.open_output_stream(f"{base}/{row.name}") as file:
                file.write(bytes(row.content))

    files.select("name", "content").foreachPartition(write)


def _page_name():
    page = F.col("page_id")
    start = F.when(page % 5 == 0, "_").when(page % 5 == 1, ".").otherwise("")
    end = F.when(page % 4 == 0, ".png").when(page % 4 == 1, ".JPG").when(page % 4 == 2, ".webp").otherwise(".txt")
    return F.concat(start, F.lit("p"), page.cast("string"), end)


_PAGE_NAME = """CASE page_id % 5 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'p' || page_id
      || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' ELSE '.txt' END"""


class _SomeUnreadable:
    """Opens files, but refuses those whose number is a multiple of 7."""

    def __call__(self, path):
        if int("".join(c for c in path.rsplit("/", 1)[1] if c.isdigit())) % 7 == 0:
            raise PermissionError(13, "Permission denied")
        return tree.open_path(path)


@query(
    "image_folder",
    f"""
    SELECT page_id, strlen(html) AS size, row_number() OVER (ORDER BY name) - 1 AS position,
      CASE WHEN strlen(html) > 3000 THEN 'skipped_too_large' WHEN page_id % 7 = 0 THEN 'failed' ELSE 'converted' END AS status,
      CASE WHEN strlen(html) > 3000 THEN 'image too large (' || strlen(html) || ' bytes > max_image_size 3000)'
        WHEN page_id % 7 = 0 THEN 'cannot be read: Permission denied' END AS error,
      CASE WHEN strlen(html) <= 3000 AND page_id % 7 <> 0 THEN 'data:image/'
        || CASE page_id % 4 WHEN 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || base64(encode(html)) END AS url
    FROM (SELECT *, {_PAGE_NAME} AS name FROM pages) WHERE page_id % 4 IN (0, 1)
    """,
)
def image_folder(t):
    """Images chosen by a brace group, hidden names among them, some too large and some unreadable, in the order of their paths."""
    folder = scratch_dir(t.spark, "images")
    _write_files(t.pages.select(_page_name().alias("name"), F.encode("html", "UTF-8").alias("content")), folder)
    images = FI.read_images(t.spark, folder, "*.{png,JPG}", 3000, _SomeUnreadable())
    out = R.convert_images(images, folder, "What is it?", model="small", max_image_size=3000)
    url = F.variant_get(F.try_element_at("body", F.lit("messages")), "$[0].content[1].image_url.url", "string")
    rows = out.select("path", F.col("length").alias("size"), "status", "error", url.alias("url"))
    return ranking.number_rows(rows, "path").select(
        F.regexp_extract("path", r"p([0-9]+)\.[^/]*$", 1).cast("bigint").alias("page_id"),
        "size", F.col("row_number").alias("position"), "status", "error", "url",
    )


@query(
    "hidden_texts",
    """
    SELECT doc_id, text AS content FROM documents
    """,
)
def hidden_texts(t):
    """Text files in folders and under names of every kind."""
    doc, folder = F.col("doc_id"), scratch_dir(t.spark, "tree")
    place = F.concat(
        F.when(doc % 3 == 0, "_sub/").when(doc % 3 == 1, ".deep/").otherwise(""),
        F.when(doc % 2 == 0, "_").otherwise("."), doc.cast("string"), F.lit(".txt"),
    )
    _write_files(t.documents.select(place.alias("name"), F.encode("text", "UTF-8").alias("content")), folder)
    out = R.convert_text_files(FI.read_text_files(t.spark, folder, "*.txt"), model="small")
    message = F.variant_get(F.try_element_at("body", F.lit("messages")), "$[0].content", "string")
    return out.select(F.regexp_extract("seq.path", r"([0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), message.alias("content"))


@query(
    "merge_files",
    """
    SELECT o_orderkey, copy, 2 * (SELECT count(*) FROM orders) + 2 AS n_lines
    FROM orders, (SELECT unnest([0, 2]) AS copy)
    """,
)
def merge_files(t):
    """Line files merged in the order given, one listed twice, one missing, bad lines left out."""
    folder = scratch_dir(t.spark, "lines")
    good = t.orders.select(F.to_json(F.struct("o_orderkey")).alias("value"))
    good.write.text(f"{folder}/a")
    t.spark.sql("SELECT explode(array('{', '# note')) AS value").write.text(f"{folder}/b")
    paths = [f"{folder}/{name}" for name in ("a", "b", "a", "missing")]
    merged = jsonl.merge_jsonl(t.spark, paths)
    n_lines = jsonl.count_requests(t.spark, [f"{folder}/{name}" for name in ("a", "b", "a")]).first()[0]
    key = F.get_json_object("line", "$.o_orderkey").cast("bigint")
    return merged.select(key.alias("o_orderkey"), F.col("seq.input").alias("copy"), F.lit(n_lines).alias("n_lines"))


def _one_document_each(opening: str, closing: str):
    """Frame the lines of every partition as one document; rows after the first begin with a comma."""

    def frame(batches):
        first = opening
        for batch in batches:
            lines = batch.column("value").to_pylist()
            if lines:
                yield pa.RecordBatch.from_pydict({"value": [first + lines[0], *("," + line for line in lines[1:])]})
                first = ","
        yield pa.RecordBatch.from_pydict({"value": [(opening if first == opening else "") + closing]})

    return frame


@query(
    "large_documents",
    """
    SELECT doc_id, text AS content, octet_length(encode(text)) AS bytes, 'list' AS shape FROM documents
    UNION ALL SELECT doc_id, text, octet_length(encode(text)), 'member' FROM documents
    """,
)
def large_documents(t):
    """Texts in JSON documents that are larger than a split, as a list and as a member of an object."""
    parts, read = _part_files(t), []
    line = F.to_json(F.struct("doc_id", "text")).alias("value")
    shapes = {"list": ("[", "]", None), "member": ('{"made": [1, 2], "items": [', '], "more": {"a": [1, 2]}}', "items")}
    for shape, (opening, closing, key) in shapes.items():
        folder = scratch_dir(t.spark, shape)
        lines = t.documents.repartition(parts, "doc_id").select(line)
        lines.mapInArrow(_one_document_each(opening, closing), "value string").write.text(folder)
        items = jsonl.read_json_items(t.spark, folder, key, split_over=1 << 14, range_bytes=1 << 19)
        read.append(items.select(
            F.try_variant_get("item", "$.doc_id", "bigint").alias("doc_id"),
            F.try_variant_get("item", "$.text", "string").alias("content"),
            F.lit(shape).alias("shape"),
        ))
    both = read[0].union(read[1])
    return both.select("doc_id", "content", F.octet_length("content").cast("bigint").alias("bytes"), "shape")


@query(
    "request_lines",
    "SELECT doc_id::VARCHAR AS custom_id, text AS content, 'small' AS model FROM documents",
)
def request_lines(t):
    """Requests written as JSON lines and read back by the strict reader."""
    folder = scratch_dir(t.spark, "requests")
    text = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    requests = R.build_requests(t.documents, F.array(text), "small", F.col("doc_id").cast("string"), 0.7, 500, seq="doc_id")
    sinks.write_requests(requests, folder)
    item = jsonl.read_prompt_pool(t.spark, folder)

    def get(path):
        return F.variant_get("item", f"$.{path}", "string")

    return item.select(get("custom_id").alias("custom_id"), get("body.messages[0].content").alias("content"), get("body.model").alias("model"))


@query(
    "results_list",
    "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'timed out' END AS error, value AS latency_ms FROM events",
)
def results_list(t):
    """Results as a bare list over part files, without metrics, and back."""
    e, folder = F.col("event_id"), scratch_dir(t.spark, "list")
    line = F.concat(
        F.lit('{"input":{"custom_id":"'), e.cast("string"), F.lit('"},"metadata":{"request_latency_ms":'),
        F.col("value").cast("string"), F.lit("}"), F.when(e % 4 == 1, ',"error":"timed out"').otherwise(""), F.lit("}"),
    )
    sinks.write_results(RS.result_from_json(t.events.select(e.alias("seq"), line.alias("line"))), folder)
    rows, _ = RS.read_run_file(t.spark, folder)
    named = M.metric_inputs(rows.withColumn("event_id", F.variant_get(F.col("input")["custom_id"], "$", "bigint")))
    return named.select("event_id", "error", "latency_ms")
