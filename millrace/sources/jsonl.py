"""JSON-lines and JSON-document sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import variants as V
from ..functions.text import strip


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The given paths that exist, as qualified URIs, in the given order."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for raw in paths:
        path = jvm.org.apache.hadoop.fs.Path(str(raw))
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found.append(fs.makeQualified(path).toUri().toString())
    return found


def _comparable(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "file:/")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with a position ``seq`` that orders them by input, file, offset and line.

    ``seq`` is a struct; nothing is sorted here. Inputs that do not exist are skipped.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    found = existing_paths(spark, wanted)
    if not found:
        return spark.createDataFrame(
            [],
            "seq struct<input:int,file:string,block:bigint,row:bigint>, source_file string, line string",
        )
    roots = list(dict.fromkeys(found))
    uri = _comparable(F.col("_metadata.file_path"))
    # a file given n times is read once and repeated here, once per position in the input list
    positions = F.array(
        *[
            F.struct(
                _comparable(F.lit(root)).alias("root"),
                F.array(*[F.lit(i) for i, u in enumerate(found) if u == root]).alias("inputs"),
            )
            for root in roots
        ]
    )
    owner = F.filter(
        positions, lambda p: (uri == p["root"]) | F.startswith(uri, F.concat(p["root"], F.lit("/")))
    )
    return (
        spark.read.text(roots)
        .select(
            "value",
            uri.alias("file"),
            P.plain_path(F.col("_metadata.file_path")).alias("source_file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.explode(F.element_at(owner, 1)["inputs"]).alias("input"),
        )
        .select(
            F.struct("input", "file", "block", "row").alias("seq"),
            "source_file",
            strip(F.col("value")).alias("line"),
        )
    )


def is_content(line: Column) -> Column:
    """Lines that are neither blank nor ``#`` comments."""
    return (line != "") & ~F.startswith(line, F.lit("#"))


def line_valid(line: Column, strict: bool = True) -> Column:
    """JSON validity of a line.

    The strict form is exact but runs in Arrow batches; the other stays in the JVM and lets
    trailing content after a complete value pass.
    """
    return V.is_json(line) if strict else F.try_parse_json(line).isNotNull()


def classify_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``line_class``: blank, comment, valid or invalid."""
    line = F.col("line")
    checked = F.when(is_content(line), line)
    return lines.withColumn("valid", line_valid(checked, strict)).select(
        *lines.columns,
        F.when(line == "", "blank")
        .when(F.startswith(line, F.lit("#")), "comment")
        .when(F.col("valid"), "valid")
        .otherwise("invalid")
        .alias("line_class"),
    )


def valid_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Content lines that parse (F2); the text stays as it was, apart from trimming."""
    kept = lines.where(is_content(F.col("line")))
    return kept.where(line_valid(F.col("line"), strict))


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Parsed JSON lines (S1): invalid ones are dropped, scalars are kept."""
    lines = valid_lines(read_lines(spark, paths), strict)
    return lines.withColumn("item", F.try_parse_json("line")).where(F.col("item").isNotNull())


def jsonl_report(lines: DataFrame, strict: bool = True) -> DataFrame:
    """One row: is every content line valid (F1), how many lines of each class, the first bad one."""
    c = F.col("line_class")
    return classify_lines(lines, strict).agg(
        (F.count_if(c == "invalid") == 0).alias("valid"),
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(c == "valid").alias("valid_lines"),
        F.count_if(c == "invalid").alias("invalid_lines"),
        F.count_if(c == "comment").alias("comment_lines"),
        F.count_if(c == "blank").alias("blank_lines"),
        F.min(F.when(c == "invalid", F.col("seq"))).alias("first_invalid"),
    )


def validate_jsonl(spark: SparkSession, path: str, strict: bool = True) -> bool:
    """True when the file exists and no content line is malformed; stops at the first bad line."""
    if not existing_paths(spark, [path]):
        return False
    bad = read_lines(spark, path).where(is_content(F.col("line")))
    return bad.where(~line_valid(F.col("line"), strict)).isEmpty()


def merge_jsonl(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> DataFrame:
    """UNION ALL of JSONL files (U1), original text, ordered by ``seq`` when a sink asks for it."""
    return valid_lines(read_lines(spark, paths), strict)


def read_prompt_pool(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Strict JSON lines (S11): only blank lines are skipped, anything else that is not JSON raises."""
    lines = read_lines(spark, paths).where(F.col("line") != "")
    checked = F.when(V.is_json(F.col("line")), F.parse_json("line")).otherwise(
        F.raise_error(F.concat(F.lit("invalid JSON line: "), F.col("line"))).cast("variant")
    )
    return lines.withColumn("item", checked)


def count_requests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Number of lines of any class."""
    return spark.read.text(paths).agg(F.count(F.lit(1)).alias("requests"))


#: Bytes above which a document is read by several tasks.
SPLIT_OVER = 64 << 20


def read_json_items(
    spark: SparkSession, paths: str | Sequence[str], json_key: str | None = None, split_over: int = SPLIT_OVER,
    range_bytes: int | None = None,
) -> DataFrame:
    """Items of JSON document files (S2), with the position in the document.

    A file up to ``split_over`` bytes is parsed by one task. A larger one is cut at its top-level elements by many
    tasks first (see ``json_split``), when this is called, in ranges of ``range_bytes`` or of the session's size; one that is a single object is one item and stays with one task.
    """
    from . import json_split

    wanted = [paths] if isinstance(paths, str) else list(paths)
    lengths = json_split.large_files(spark, wanted, split_over)
    cut, whole = json_split.large_items(spark, lengths, json_key, range_bytes) if lengths else (None, [])
    file = json_split.comparable(F.col("_metadata.file_path"))
    docs = spark.read.text(wanted, wholetext=True)
    # files that are cut are left out by the listing
    docs = docs.where((F.col("_metadata.file_size") <= split_over) | file.isin(whole) if whole else F.col("_metadata.file_size") <= split_over)
    docs = docs.select(P.plain_path(F.col("_metadata.file_path")).alias("source_file"), "value")
    items = json_split._long_positions(json_items(docs, json_key))
    return items if cut is None else items.unionByName(cut)


def json_items(docs: DataFrame, json_key: str | None = None) -> DataFrame:
    """Items of documents ``source_file, value``, one row per array element or single object.

    ``raw`` keeps an object's or array's own text; ``error`` is set on the single row of an
    unusable document.
    """
    root = F.try_parse_json(F.col("value"))
    docs = docs.withColumn("ok", V.is_json(F.col("value"))).withColumn(
        "doc", F.when(F.col("ok"), root)
    )
    text, doc = F.col("value"), F.col("doc")
    if json_key is not None:
        doc_map = V.as_object(doc)
        docs = docs.withColumn("has_key", F.coalesce(F.map_contains_key(doc_map, json_key), F.lit(False)))
        picked = F.try_element_at(doc_map, F.lit(json_key))
        picked_raw = F.element_at(F.from_json(text, "map<string,string>"), json_key)
        docs = docs.select("source_file", "ok", "has_key", picked.alias("doc"), picked_raw.alias("value"))
        unusable = F.when(~F.col("ok"), "JSON decode error").when(
            ~F.col("has_key"), f"Key '{json_key}' not found in JSON"
        )
    else:
        unusable = F.when(~F.col("ok"), "JSON decode error")
    docs = docs.withColumn("kind", V.kind(doc)).withColumn("error", unusable)
    docs = docs.withColumn(
        "error",
        F.coalesce(
            "error",
            F.when(
                F.coalesce("kind", F.lit("null")).isin("object", "array"), F.lit(None)
            ).otherwise(F.concat(F.lit("Unsupported JSON format: "), F.coalesce("kind", F.lit("null")))),
        ),
    )
    entries = (
        F.when(F.col("error").isNotNull(), F.array(F.struct(
            F.lit(None).cast("variant").alias("item"), F.lit(None).cast("string").alias("raw"))))
        .when(F.col("kind") == "object", F.array(F.struct(doc.alias("item"), text.alias("raw"))))
        .otherwise(
            F.arrays_zip(
                V.as_list(doc).alias("item"), F.from_json(text, "array<string>").alias("raw")
            )
        )
    )
    return docs.select("source_file", "error", F.posexplode(entries).alias("pos", "entry")).select(
        F.struct("source_file", "pos").alias("seq"),
        "source_file",
        F.col("entry.item").alias("item"),
        F.when(V.kind(F.col("entry.item")).isin("object", "array"), F.col("entry.raw")).alias("raw"),
        "error",
    )
