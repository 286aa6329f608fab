"""Sources to requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import variants as V
from ..operators import items as I
from ..operators import reports
from ..operators import requests as R
from ..sources import csv_rows, files, jsonl
from ..session import scratch_dir
from .registry import query

TEXT_LIMIT = 16384


def document_files(t):
    """Documents as text files."""
    return t.documents.select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").alias("content"),
        F.col("doc_id").cast("string").alias("doc_key"),
    )


def _line(converted):
    return F.when(F.col("error").isNull(), R.request_json(converted)).alias("line")


@query(
    "text_requests",
    f"""
    SELECT CASE WHEN ok THEN doc_id::VARCHAR END AS custom_id,
      CASE WHEN ok THEN json_object('custom_id', doc_id::VARCHAR, 'method', 'POST',
        'url', '/v1/chat/completions',
        'body', json_object('max_tokens', 200,
          'messages', json_array(
            json_object('content', 'Be brief.', 'role', 'system'),
            json_object('content', 'Summarize:' || chr(10) || text, 'role', 'user')),
          'model', 'small', 'temperature', 0.7, 'top_p', 0.95),
        'metadata', json_object('file_extension', '.txt', 'file_size', bytes, 'source_file', path)
      )::VARCHAR END AS line,
      CASE WHEN NOT ok THEN 'File ' || path || ' exceeds size limit: ' || bytes || ' > {TEXT_LIMIT}' END AS error
    FROM (SELECT *, strlen(text) AS bytes, '/corpus/' || source || '/' || doc_id || '.txt' AS path,
            strlen(text) <= {TEXT_LIMIT} AS ok FROM documents)
    """,
)
def text_requests(t):
    out = R.convert_text_files(
        document_files(t), "Summarize:\n{content}", "Be brief.", "small",
        {"max_tokens": 200, "top_p": 0.95}, max_file_size=TEXT_LIMIT, custom_id=F.col("doc_key"),
    )
    return out.select("custom_id", _line(out), "error")


def part_rows(t):
    return t.part.select(
        F.col("p_partkey").alias("seq"), F.lit("part.csv").alias("source_file"), F.struct("*").alias("row")
    )


_PART_LINE = """
    SELECT p_partkey::VARCHAR AS custom_id,
      json_object('custom_id', p_partkey::VARCHAR, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('max_tokens', 500, 'messages', json_array(json_object(
            'content', p_name || ' by ' || p_brand || ', size ' || p_size || ': ' || p_retailprice || ' {x}',
            'role', 'user')),
          'model', 'small', 'temperature', 0.7),
        'metadata', json_object('csv_row', json_object('p_brand', p_brand, 'p_name', p_name,
            'p_partkey', p_partkey, 'p_retailprice', p_retailprice, 'p_size', p_size, 'p_type', p_type),
          'source_file', 'part.csv'))::VARCHAR AS line
    FROM part
    """
_PART_TEMPLATE = "{p_name} by {p_brand}, size {p_size}: {no_such_column}{p_retailprice} {{x}}"


@query("csv_template_requests", _PART_LINE)
def csv_template_requests(t):
    out = R.convert_rows(part_rows(t), _PART_TEMPLATE, model="small", id_column="p_partkey")
    return out.select("custom_id", _line(out))


@query("csv_source_requests", _PART_LINE)
def csv_source_requests(t):
    """The same requests with the table written to and read from CSV files."""
    folder = scratch_dir(t.spark, "csv")
    t.part.write.csv(folder, header=True)
    rows = csv_rows.read_csv_rows(t.spark, folder, t.part.schema)
    rows = rows.withColumn("source_file", F.lit("part.csv"))
    out = R.convert_rows(rows, _PART_TEMPLATE, model="small", id_column="p_partkey")
    return out.select("custom_id", _line(out))


@query(
    "csv_column_requests",
    """
    SELECT item_id::VARCHAR AS custom_id, text AS content, 'You are careful.' AS system_content
    FROM benchmark
    """,
)
def csv_column_requests(t):
    rows = t.benchmark.select(
        F.col("item_id").alias("seq"), F.lit("benchmark.csv").alias("source_file"), F.struct("*").alias("row")
    )
    out = R.convert_rows(
        rows, prompt_column="text", system_prompt="You are careful.", id_column="item_id"
    )
    messages = V.as_list(F.try_element_at("body", F.lit("messages")))

    def content(i):
        return F.variant_get(F.element_at(messages, i), "$.content", "string")

    return out.select("custom_id", content(2).alias("content"), content(1).alias("system_content"))


@query(
    "formatted_requests",
    """
    SELECT c_custkey::VARCHAR AS custom_id,
      lpad(c_nationkey::VARCHAR, 4, '0') || '|' || rpad(c_mktsegment, 12, ' ') || '|' AS content
    FROM customer
    """,
)
def formatted_requests(t):
    """Template with format specs: the Arrow path of the renderer."""
    rows = t.customer.select(
        F.col("c_custkey").alias("seq"), F.lit("customer.csv").alias("source_file"), F.struct("*").alias("row")
    )
    out = R.convert_rows(rows, "{c_nationkey:04d}|{c_mktsegment:<12}|", id_column="c_custkey")
    first = F.element_at(V.as_list(F.try_element_at("body", F.lit("messages"))), 1)
    return out.select("custom_id", F.variant_get(first, "$.content", "string").alias("content"))


def _items(df, seq, source, text):
    """JSON texts as items."""
    return df.select(
        seq.alias("seq"), F.lit(source).alias("source_file"),
        F.parse_json(text).alias("item"), text.alias("raw"),
    )


@query(
    "batch_items",
    """
    SELECT o_orderkey::VARCHAR AS custom_id,
      json_object('custom_id', o_orderkey::VARCHAR, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object(
          'messages', json_array(json_object('content', o_orderpriority, 'role', 'user')),
          'model', CASE WHEN o_orderstatus = 'F' THEN 'own' ELSE 'small' END, 'top_p', 0.9),
        'order', o_orderkey)::VARCHAR AS line
    FROM orders
    """,
)
def batch_items(t):
    body = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), F.col("o_orderpriority").alias("content"))).alias("messages"),
        F.when(F.col("o_orderstatus") == "F", "own").alias("model"),
    )
    text = F.to_json(
        F.struct(
            F.lit("POST").alias("method"), F.lit(R.CHAT_URL).alias("url"), body.alias("body"),
            F.col("o_orderkey").alias("order"),
        )
    )
    out = I.convert_items(
        _items(t.orders, F.col("o_orderkey"), "orders.json", text), model="small", id_field="order",
        api_parameters={"top_p": 0.9},
    )
    return out.select("custom_id", _line(out))


@query(
    "messages_template",
    """
    SELECT conv_id || '-' || turn AS custom_id,
      json_object('custom_id', conv_id || '-' || turn, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('conv', conv_id, 'max_tokens', 500,
          'messages', json_array(json_object('content',
             CASE WHEN role = 'user' THEN 'Tell me about: ' || text ELSE text END, 'role', role)),
          'model', 'small', 'temperature', 0.7),
        'metadata', json_object('source_file', 'conversations.json'))::VARCHAR AS line
    FROM conversations
    """,
)
def messages_template(t):
    text = F.to_json(
        F.struct(
            F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"),
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.col("conv_id").alias("conv"),
        )
    )
    out = I.convert_items(
        _items(t.conversations, F.struct("conv_id", "turn"), "conversations.json", text),
        model="small", prompt_template="Tell me about: {content}",
    )
    return out.select("custom_id", _line(out))


@query(
    "prompt_items",
    """
    SELECT doc_id::VARCHAR AS custom_id,
      json_object('custom_id', doc_id::VARCHAR, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('doc', doc_id, 'max_tokens', 500,
          'messages', json_array(
             json_object('content', 'Language: ' || lang, 'role', 'system'),
             json_object('content', 'Read: ' || text, 'role', 'user')),
          'model', source, 'temperature', 0.7),
        'metadata', json_object('source_file', 'documents.json'))::VARCHAR AS line
    FROM documents
    """,
)
def prompt_items(t):
    text = F.to_json(
        F.struct(
            F.col("text").alias("prompt"),
            F.concat(F.lit("Language: "), "lang").alias("system"),
            F.col("source").alias("model"),
            F.col("doc_id").alias("doc"),
        )
    )
    out = I.convert_items(
        _items(t.documents, F.col("doc_id"), "documents.json", text), id_field="doc",
        prompt_template="Read: {content}",
    )
    return out.select("custom_id", _line(out))


@query(
    "generic_items",
    """
    SELECT c_custkey::VARCHAR AS custom_id,
      '{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "c_acctbal": ' || c_acctbal
        || ', "tags": ["' || c_mktsegment || '", ' || c_nationkey || ']}' AS content,
      json_object('original_item', json_object('c_acctbal',
          CASE WHEN c_acctbal = floor(c_acctbal) THEN to_json(c_acctbal::BIGINT) ELSE to_json(c_acctbal) END, 'c_custkey', c_custkey,
          'c_name', c_name, 'tags', json_array(c_mktsegment, c_nationkey)),
        'source_file', 'customer.json')::VARCHAR AS metadata
    FROM customer
    """,
)
def generic_items(t):
    """Objects of no known shape; the prompt keeps ``900.0``, a JSON value prints as ``900``."""
    text = F.to_json(
        F.struct(
            "c_custkey", "c_name", "c_acctbal",
            F.array(
                F.col("c_mktsegment").cast("variant"), F.col("c_nationkey").cast("variant")
            ).alias("tags"),
        )
    )
    out = I.convert_items(
        _items(t.customer, F.col("c_custkey"), "customer.json", text), id_field="c_custkey"
    )
    first = F.element_at(V.as_list(F.try_element_at("body", F.lit("messages"))), 1)
    return out.select(
        "custom_id", F.variant_get(first, "$.content", "string").alias("content"),
        F.to_json("metadata").alias("metadata"),
    )


@query(
    "scalar_items",
    "SELECT item_id, 'Q: ' || text AS content FROM benchmark",
)
def scalar_items(t):
    """Plain strings as items, wrapped as JSON strings."""
    text = F.to_json(F.col("text").cast("variant"))
    out = I.convert_items(
        _items(t.benchmark, F.col("item_id"), "benchmark.json", text), prompt_template="Q: {content}"
    )
    first = F.element_at(V.as_list(F.try_element_at("body", F.lit("messages"))), 1)
    return out.select(
        F.col("seq").alias("item_id"), F.variant_get(first, "$.content", "string").alias("content")
    )


def _mixed_items(t):
    """Items of every shape, picked by ``event_id % 8``, around the event's own values."""
    k = F.get_json_object("props", "$.k")
    shape = F.col("event_id") % 8
    text = (
        F.when(shape == 0, F.concat(F.lit('{"method":"POST","url":"/v1/chat/completions","body":{"messages":[],"k":'), k, F.lit("}}")))
        .when(shape == 1, F.concat(F.lit('{"messages":[{"role":"user","content":"'), "event_type", F.lit('"}],"k":'), k, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"prompt":"'), "event_type", F.lit('","k":'), k, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"prompt":"'), "event_type", F.lit('","temperature":0.'), k, F.lit("}")))
        .when(shape == 4, F.col("props"))
        .when(shape == 5, F.concat(F.lit('"'), "event_type", F.when(F.col("event_type") == "view", " messages").otherwise(""), F.lit('"')))
        .when(shape == 6, F.concat(F.lit('["'), "event_type", F.lit('",'), k, F.lit("]")))
        .otherwise(k)
    )
    return _items(t.events, F.col("event_id"), "events.json", text)


_CLASSES = """
    SELECT event_id,
      CASE event_id % 8 WHEN 0 THEN 'batch' WHEN 1 THEN 'messages' WHEN 2 THEN 'prompt'
        WHEN 3 THEN 'prompt' WHEN 4 THEN 'generic'
        WHEN 5 THEN CASE WHEN event_type = 'view' THEN 'invalid' ELSE 'scalar' END
        WHEN 6 THEN 'scalar' ELSE 'invalid' END AS item_class,
      CASE event_id % 8 WHEN 3 THEN false WHEN 7 THEN false
        WHEN 5 THEN event_type <> 'view' ELSE true END AS ok
    FROM events
    """


@query("item_format_classes", _CLASSES)
def item_format_classes(t):
    out = I.convert_items(_mixed_items(t), model="small")
    return out.select(F.col("seq").alias("event_id"), "item_class", F.col("error").isNull().alias("ok"))


@query(
    "conversion_report",
    f"""
    SELECT item_class, count(*) AS total, count(*) FILTER (ok) AS successful_conversions,
      count(*) FILTER (NOT ok) AS failed_conversions
    FROM ({_CLASSES}) GROUP BY item_class
    """,
)
def conversion_report(t):
    return reports.conversion_report(I.convert_items(_mixed_items(t), model="small"), "item_class")


@query(
    "json_documents",
    """
    WITH items AS (
      SELECT o_orderkey, 0 AS pos, o_orderpriority AS label, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')
      UNION ALL SELECT o_orderkey, 1, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, pos, label, NULL AS error FROM items
    UNION ALL
    SELECT o_orderkey, 0, NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'JSON decode error'
      ELSE 'Unsupported JSON format: string' END FROM orders WHERE o_orderstatus = 'P'
    """,
)
def json_documents(t):
    """Documents holding a list, an object, a bare string or broken text."""
    return _order_documents(t).select(
        F.col("source_file").cast("bigint").alias("o_orderkey"), F.col("seq.pos").alias("pos"),
        F.try_variant_get("item", "$.label", "string").alias("label"), "error",
    )


def _order_documents(t):
    key, label = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    item = F.concat(F.lit('{"label":"'), label, F.lit('"}'))
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
        .when(F.col("o_orderstatus") == "O", item)
        .when(F.col("o_orderkey") % 2 == 0, F.concat(item, F.lit(" trailing")))
        .otherwise(F.concat(F.lit('"'), label, F.lit('"')))
    )
    return jsonl.json_items(t.orders.select(key.alias("source_file"), text.alias("value")))


@query(
    "json_report",
    """
    SELECT o_orderkey, o_orderstatus <> 'P' AS success,
      CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'JSON decode error'
        ELSE 'Unsupported JSON format: string' END END AS error,
      CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS total_items,
      CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS successful_conversions,
      0 AS failed_conversions
    FROM orders
    """,
)
def json_report(t):
    """What became of each document: an unusable one fails and counts no items."""
    items = _order_documents(t)
    report = reports.document_report(items, I.convert_items(items.where("error IS NULL"), model="small"))
    return report.select(F.col("source_file").cast("bigint").alias("o_orderkey"), *report.columns[1:])


_PAGE_PATH = """'/site/' || CASE page_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'build' ELSE 'fr' END || '/'
      || CASE page_id % 5 WHEN 0 THEN '.p' ELSE 'p.' END || page_id
      || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.HTML' ELSE '.md' END"""


def page_files(t):
    page = F.col("page_id")
    folder = F.when(page % 4 == 0, "en").when(page % 4 == 1, "build").otherwise("fr")
    name = F.concat(F.when(page % 5 == 0, ".p").otherwise("p."), page.cast("string"))
    end = F.when(page % 3 == 0, ".html").when(page % 3 == 1, ".HTML").otherwise(".md")
    return t.pages.select(
        "page_id",
        F.concat(F.lit("/site/"), folder, F.lit("/"), name, end).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )


@query(
    "file_filters",
    f"""
    SELECT page_id, path, path[7:] AS relative, regexp_extract(path, '[^/]+$') AS name,
      regexp_extract(path, '\\.[^./]+$') AS suffix,
      regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem
    FROM (SELECT page_id, {_PAGE_PATH} AS path FROM pages)
    WHERE regexp_matches(path, '\\.(html|md)$') AND NOT regexp_matches(path, '/build/[^/]*$')
      AND NOT regexp_matches(path, '/p[^/]*9\\.md$')
    """,
)
def file_filters(t):
    kept = files.select_files(
        page_files(t), "/site", "*.*", extensions=["html", ".md"], exclude_patterns=["build/*", "p*9.md"]
    )
    path = F.col("path")
    return kept.select(
        "page_id", "path", P.relative_to(path, "/site").alias("relative"),
        P.basename(path).alias("name"), P.suffix(path).alias("suffix"), P.stem(path).alias("stem"),
    )


IMAGE_LIMIT = 6000

_IMAGES = """
    (SELECT page_id, '/img/' || page_id || '.' || ext AS path, page_id || '.' || ext AS name, strlen(html) AS size, html,
       CASE ext WHEN 'PNG' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp'
         ELSE 'application/octet-stream' END AS mime
     FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' ELSE 'bin' END AS ext FROM pages))
    """


def page_images(t):
    page = F.col("page_id")
    ext = F.when(page % 4 == 0, "PNG").when(page % 4 == 1, "jpg").when(page % 4 == 2, "webp").otherwise("bin")
    return t.pages.select(
        F.concat(F.lit("/img/"), page.cast("string"), F.lit("."), ext).alias("path"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.encode("html", "UTF-8").alias("content"),
    )


@query(
    "image_requests",
    f"""
    SELECT CASE WHEN ok THEN page_id::VARCHAR END AS custom_id, path, size AS length,
      CASE WHEN ok THEN 'converted' ELSE 'skipped_too_large' END AS status,
      CASE WHEN ok THEN json_object('custom_id', page_id::VARCHAR, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('max_tokens', 500, 'messages', json_array(
            json_object('content', 'You see.', 'role', 'system'),
            json_object('content', json_array(
              json_object('text', 'Describe what you see in this image.', 'type', 'text'),
              json_object('image_url', json_object('url', 'data:' || mime || ';base64,' || to_base64(encode(html))),
                'type', 'image_url')), 'role', 'user')),
          'model', 'vision', 'temperature', 0.7),
        'metadata', json_object('filename', name, 'filepath', name, 'size', size))::VARCHAR END AS line
    FROM (SELECT *, size <= {IMAGE_LIMIT} AS ok FROM {_IMAGES})
    """,
)
def image_requests(t):
    out = R.convert_images(
        page_images(t), "/img", system_prompt="You see.", model="vision", max_image_size=IMAGE_LIMIT
    )
    return out.select("custom_id", "path", "length", "status", _line(out))


@query(
    "vision_report",
    f"""
    SELECT count(*) AS found, count(*) FILTER (size <= {IMAGE_LIMIT}) AS converted,
      count(*) FILTER (size > {IMAGE_LIMIT}) AS skipped_too_large, 0::BIGINT AS failed
    FROM {_IMAGES}
    """,
)
def vision_report(t):
    return reports.vision_report(R.convert_images(page_images(t), "/img", max_image_size=IMAGE_LIMIT))


@query(
    "image_issues",
    f"""
    SELECT path, size, {IMAGE_LIMIT}::BIGINT AS "limit", 'skipped_too_large' AS status,
      'image too large (' || size || ' bytes > max_image_size {IMAGE_LIMIT})' AS error
    FROM {_IMAGES} WHERE size > {IMAGE_LIMIT}
    """,
)
def image_issues(t):
    out = R.convert_images(page_images(t), "/img", max_image_size=IMAGE_LIMIT)
    return reports.image_issues(out, IMAGE_LIMIT)


@query(
    "data_url",
    """
    SELECT doc_id, 'data:' || CASE lang WHEN 'en' THEN 'image/png' WHEN 'fr' THEN 'image/gif'
        ELSE 'application/octet-stream' END || ';base64,' || to_base64(encode(text)) AS url
    FROM documents
    """,
)
def data_url(t):
    ext = F.when(F.col("lang") == "en", ".png").when(F.col("lang") == "fr", ".GIF").otherwise("")
    path = F.concat(F.lit("/i/x"), ext)
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("data:"), P.mime_type(path), F.lit(";base64,"), F.base64(F.encode("text", "UTF-8"))).alias("url"),
    )


@query(
    "prompt_lookup",
    """
    SELECT d.doc_id, coalesce(p.prompt, n.prompt, 'Describe this.') AS prompt
    FROM documents d
    LEFT JOIN (SELECT doc_id, 'Quality ' || quality AS prompt FROM labels WHERE toxic = 0) p USING (doc_id)
    LEFT JOIN (SELECT doc_id % 50 AS name, max('Toxic ' || quality) AS prompt FROM labels WHERE toxic = 1 GROUP BY 1) n
      ON n.name = d.doc_id % 50
    """,
)
def prompt_lookup(t):
    """Full paths from clean labels, file names (shared by many paths) from toxic ones."""
    name = F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string"), F.lit(".png"))
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit("/"), name)
    clean = t.labels.where("toxic = 0").select(
        path.alias("key"), F.concat(F.lit("Quality "), "quality").alias("prompt")
    )
    toxic = t.labels.where("toxic = 1").select(
        name.alias("key"), F.concat(F.lit("Toxic "), "quality").alias("prompt")
    )
    looked = R.with_prompts(
        t.documents.select("doc_id", path.alias("path")), clean.unionByName(toxic), "Describe this."
    )
    return looked.select("doc_id", "prompt")


_SYSTEM_CASE = "CASE doc_id % 6 " + " ".join(
    f"WHEN {i} THEN '{R.CATEGORY_SYSTEM_PROMPTS[c]}'" for i, c in enumerate(R.CATEGORIES)
) + " END"


@query(
    "turn_messages",
    f"""
    SELECT doc_id, to_json(list_concat(
        [{{'content': {_SYSTEM_CASE}, 'role': 'system'}}],
        [{{'content': x, 'role': 'user'}} for x in string_split(text, chr(10))]))::VARCHAR AS messages
    FROM documents
    """,
)
def turn_messages(t):
    """Each document's lines as the turns of one conversation, its category by ``doc_id % 6``."""
    category = F.element_at(
        F.array(*[F.lit(c) for c in R.CATEGORIES]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    messages = R.turn_messages(F.split("text", "\n"), category)
    return t.documents.select(
        "doc_id", F.to_json(F.to_variant_object(messages)).alias("messages")
    )
