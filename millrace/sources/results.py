"""Result files (S6) and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import variants as V

_METRIC_MAPS = ("run_metrics", "vllm_metrics", "gpu_metrics")


def result_from_json(rows: DataFrame, text: str = "line") -> DataFrame:
    """Result objects to columns; missing ``input`` and ``metadata`` become empty objects."""
    body = F.col("_result")
    empty = F.from_json(F.lit("{}"), V.OBJECT)

    def member(name):
        value = F.try_element_at(body, F.lit(name))
        return F.when(~F.is_variant_null(value), value)

    return (
        rows.withColumn("_result", V.parse_object(F.col(text)))
        .select(
            *[c for c in rows.columns if c != text],
            F.coalesce(V.as_object(member("input")), empty).alias("input"),
            F.coalesce(V.as_object(member("metadata")), empty).alias("metadata"),
            member("output").alias("output"),
            member("error").cast("string").alias("error"),
        )
    )


def read_run_file(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Run files in either form, an envelope object or a bare list.

    Returns the result rows and, per file, the three metric maps (empty where absent; values are the
    JSON texts as written). A single file is parsed by one task. A folder of parts, as
    ``sinks.write_envelope`` and ``sinks.write_results`` write it, is read line by line at any size;
    its rows carry the folder as ``source_file`` and a unique ``pos``.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    folders = [p for p in wanted if _has_parts(spark, p)]
    files = [p for p in wanted if p not in folders]
    read = [_run_folder(spark, p) for p in folders] + ([_run_documents(spark, files)] if files else [])
    rows, maps = read[0]
    for more_rows, more_maps in read[1:]:
        rows, maps = rows.unionByName(more_rows), maps.unionByName(more_maps)
    return result_from_json(rows), maps


def _has_parts(spark: SparkSession, path: str) -> bool:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/part-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(pattern) or []) > 0


def _metric_maps(envelope) -> list:
    texts = "map<string,string>"
    return [
        F.coalesce(
            F.from_json(F.try_element_at(envelope, F.lit(m)), texts), F.from_json(F.lit("{}"), texts)
        ).alias(m)
        for m in _METRIC_MAPS
    ]


def _run_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parts of one document: its first and last line frame the rows, later rows begin with a comma."""
    lines = spark.read.text(path)
    value = F.col("value")
    framed = value.isin("[", '{"results":[', "") | F.startswith(value, F.lit("]"))
    rows = lines.where(~framed).select(
        F.lit(path).alias("source_file"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace(value, "^,", "").alias("line"),
    )
    last = lines.where(F.startswith(value, F.lit("]"))).agg(F.max(value).alias("value"))
    # the list's end becomes that of an empty one, in an object for the bare form
    closed = F.concat(F.lit('{"results":['), F.coalesce(F.nullif(value, F.lit("]")), F.lit("]}")))
    envelope = F.from_json(closed, "map<string,string>")
    return rows, last.select(F.lit(path).alias("source_file"), *_metric_maps(envelope))


def _run_documents(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.text(paths, wholetext=True).select(
        P.plain_path(F.col("_metadata.file_path")).alias("source_file"), F.col("value")
    )
    envelope = F.from_json("value", "map<string,string>")
    rows = F.from_json(
        F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(
            F.try_element_at(envelope, F.lit("results"))
        ),
        "array<string>",
    )
    results = docs.select("source_file", F.posexplode(rows).alias("pos", "line"))
    return results.withColumn("pos", F.col("pos").cast("long")), docs.select("source_file", *_metric_maps(envelope))
