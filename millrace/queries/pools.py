"""Line hygiene, merging, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import requests as R
from ..operators import ranking, sampling
from ..plans.benchmark import benchmark_requests
from ..session import scratch_dir
from ..sources import jsonl
from .registry import query

_LINE_CLASS = """CASE turn % 5 WHEN 0 THEN 'comment' WHEN 1 THEN 'blank' WHEN 2 THEN 'invalid'
      WHEN 3 THEN 'invalid' ELSE 'valid' END"""


def conversation_lines(t):
    """Conversation turns as comment, blank, cut-off, trailing-junk and good lines, by turn."""
    doc = F.to_json(F.struct("role", "text"))
    kind = F.col("turn") % 5
    line = (
        F.when(kind == 0, F.concat(F.lit("  # "), "text"))
        .when(kind == 1, F.lit(" \t "))
        .when(kind == 2, F.rtrim(doc, F.lit("}")))
        .when(kind == 3, F.concat(doc, F.lit(" x")))
        .otherwise(F.concat(F.lit("\t"), doc, F.lit(" ")))
    )
    return t.conversations.select(
        F.struct("conv_id", "turn").alias("seq"), F.lit("conversations.jsonl").alias("source_file"),
        jsonl.strip(line).alias("line"),
    )


@query(
    "jsonl_hygiene",
    f"SELECT conv_id, turn, {_LINE_CLASS} AS line_class FROM conversations",
)
def jsonl_hygiene(t):
    out = jsonl.classify_lines(conversation_lines(t))
    return out.select("seq.conv_id", "seq.turn", "line_class")


@query(
    "jsonl_report",
    f"""
    SELECT count(*) FILTER (c = 'invalid') = 0 AS valid, count(*) AS total_lines,
      count(*) FILTER (c = 'valid') AS valid_lines, count(*) FILTER (c = 'invalid') AS invalid_lines,
      count(*) FILTER (c = 'comment') AS comment_lines, count(*) FILTER (c = 'blank') AS blank_lines,
      min(conv_id) FILTER (c = 'invalid') AS first_invalid_conv
    FROM (SELECT *, {_LINE_CLASS} AS c FROM conversations)
    """,
)
def jsonl_report(t):
    report = jsonl.jsonl_report(conversation_lines(t))
    return report.withColumn("first_invalid_conv", F.col("first_invalid.conv_id")).drop("first_invalid")


@query(
    "read_lines",
    """
    SELECT conv_id, turn, role, text FROM conversations
    """,
)
def read_lines(t):
    """All turns written to text files, with notes and broken lines among them, and read back as items."""
    folder = scratch_dir(t.spark, "lines")
    doc = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    turn = F.col("turn") % 5
    before = F.when(turn == 0, F.array(F.lit("# note"), F.lit(""))).when(turn == 1, F.array(F.lit("{"), F.concat(doc, F.lit(" x"))))
    lines = F.concat(F.coalesce(before, F.array().cast("array<string>")), F.array(doc))
    t.conversations.select(F.explode(lines).alias("value")).write.text(folder)
    item = jsonl.read_jsonl(t.spark, folder)

    def get(name, kind):
        return F.variant_get("item", f"$.{name}", kind).alias(name)

    return item.select(get("conv_id", "bigint"), get("turn", "bigint"), get("role", "string"), get("text", "string"))


@query(
    "merge_sources",
    """
    SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark
    UNION ALL SELECT 'documents', doc_id, text FROM documents
    """,
)
def merge_sources(t):
    """UNION ALL of two line sources, duplicates kept."""

    def lines(df, origin, id_column):
        doc = F.to_json(F.struct(F.lit(origin).alias("origin"), F.col(id_column).alias("id"), "text"))
        return df.select(F.struct(F.lit(origin), id_column).alias("seq"), doc.alias("line"))

    both = lines(t.benchmark, "benchmark", "item_id").union(lines(t.documents, "documents", "doc_id"))
    item = F.from_json("line", "struct<origin:string,id:bigint,text:string>")
    return jsonl.valid_lines(both).select(item.alias("i")).select("i.*")


@query(
    "merge_distinct",
    "SELECT md5(text) AS digest FROM benchmark UNION SELECT md5(text) FROM documents",
)
def merge_distinct(t):
    """Set union: equal texts of either source once."""
    return t.benchmark.select(F.md5("text").alias("digest")).union(
        t.documents.select(F.md5("text").alias("digest"))
    ).distinct()


@query(
    "json_array_roundtrip",
    "SELECT doc_id, text, lang FROM documents",
)
def json_array_roundtrip(t):
    """Documents as one ordered JSON array over part files, read back."""
    folder = scratch_dir(t.spark, "array")
    rows = t.documents.select("doc_id", F.to_json(F.struct("doc_id", "text", "lang")).alias("line"))
    sinks.write_json_document(rows, folder, "doc_id")
    back = sinks.read_json_document(t.spark, folder)
    return back.select(F.from_json("line", "doc_id bigint, text string, lang string").alias("d")).select("d.*")


@query(
    "batch_chunks",
    """
    SELECT event_id, n // 4 AS batch_id, n % 4 AS pos_in_batch, (n + 1) % 4 = 0 AND (n + 1) % 50 = 0 AS save_point
    FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)
    """,
)
def batch_chunks(t):
    return sampling.batch_chunks(t.events.select("event_id"), "event_id", 4, 50).select(
        "event_id", "batch_id", "pos_in_batch", "save_point"
    )


@query(
    "sparse_numbers",
    """
    SELECT spread, row_number() OVER (ORDER BY spread) - 1 AS row_number, (SELECT count(*) FROM events) AS total
    FROM (SELECT event_id * 7919000003 % 1099511627689 AS spread FROM events)
    """,
)
def sparse_numbers(t):
    """Row numbers in the order of numbers that lie far apart."""
    spread = F.col("event_id") * F.lit(7919000003) % F.lit(1099511627689)
    rows = ranking.number_rows(t.events.select(spread.alias("spread")), "spread")
    return rows.select("spread", "row_number", F.col("_total").alias("total"))


_LANGS = ("en", "de", "fr", "es")


@query(
    "stratified_sample",
    """
    SELECT doc_id, lang, rank, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS category_pos
    FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS rank FROM documents)
    WHERE rank <= 200 // 4
    """,
)
def stratified_sample(t):
    return sampling.stratified_sample(
        t.documents.select("doc_id", "lang"), 200, "lang", "doc_id", _LANGS
    ).select("doc_id", "lang", "rank", "category_pos")


@query(
    "prompt_subset",
    """
    SELECT doc_id, text, row_number() OVER (ORDER BY md5('7|' || doc_id)) AS draw_rank FROM documents
    QUALIFY draw_rank <= 120
    """,
)
def prompt_subset(t):
    return sampling.prompt_subset(t.documents.select("doc_id", "text"), 120, "doc_id", seed=7)


_CATEGORY_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(R.CATEGORIES)) + " END"
_PROMPT_SQL = "CASE category " + " ".join(
    f"WHEN '{c}' THEN '{p}'" for c, p in R.CATEGORY_SYSTEM_PROMPTS.items()
) + " END"


@query(
    "benchmark_prompts",
    f"""
    SELECT category || '-' || doc_id AS custom_id,
      json_object('custom_id', category || '-' || doc_id, 'method', 'POST', 'url', '/v1/chat/completions',
        'body', json_object('max_tokens', 300,
          'messages', list_concat([{{'content': {_PROMPT_SQL}, 'role': 'system'}}],
            [{{'content': x, 'role': 'user'}} for x in string_split(text, chr(10))]),
          'model', 'small', 'temperature', 0.7))::VARCHAR AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || doc_id)) AS rank
      FROM (SELECT *, {_CATEGORY_SQL} AS category FROM documents))
    WHERE rank <= 100 // 6
    """,
)
def benchmark_prompts(t):
    """Documents as a six-category dataset, their lines as turns; 100 prompts asked for, 16 each."""
    category = F.element_at(
        F.array(*[F.lit(c) for c in R.CATEGORIES]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    dataset = t.documents.select(
        "doc_id", category.alias("category"), F.split("text", "\n").alias("turns")
    )
    out = benchmark_requests(dataset, 100, "small", max_tokens=300, id_column="doc_id")
    return out.select("custom_id", R.request_json(out))
