"""Telemetry sources: exposition text (S8) and GPU utilisation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

# Fixed value: a sample line is a name with optional labels, blanks and a number.
SAMPLE_PATTERN = r"^(\S+)\s+([-\d.eE+]+)"


def parse_exposition(
    lines: DataFrame, keys: list[str], text: str = "line", order_by: str = "seq"
) -> DataFrame:
    """Exposition lines to ``keys, name, labels, value``.

    Comments, blank lines and values that are not plain numbers are dropped. Of two lines with
    equal name and labels in one sample the later wins, decided by an aggregate that combines
    before the shuffle.
    """
    line = F.col(text)
    full_name = F.regexp_extract(line, SAMPLE_PATTERN, 1)
    number = F.regexp_extract(line, SAMPLE_PATTERN, 2).try_cast("double")
    has_labels = F.contains(full_name, F.lit("{"))
    parsed = lines.where(~F.startswith(line, F.lit("#")) & line.rlike(SAMPLE_PATTERN)).select(
        *keys,
        F.col(order_by).alias("_order"),
        F.substring_index(full_name, "{", 1).alias("name"),
        F.when(
            has_labels, F.rtrim(F.regexp_replace(full_name, r"^[^{]*\{", ""), F.lit("}"))
        ).otherwise("").alias("labels"),
        number.alias("value"),
    )
    return (
        parsed.where(F.col("value").isNotNull())
        .groupBy(*keys, "name", "labels")
        .agg(F.max_by("value", "_order").alias("value"))
    )


def read_snapshots(spark: SparkSession, paths) -> DataFrame:
    """One exposition file per sample: ``sample, name, labels, value``."""
    lines = spark.read.text(paths).select(
        P.plain_path(F.col("_metadata.file_path")).alias("sample"),
        F.struct(
            F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
        ).alias("seq"),
        F.col("value").alias("line"),
    )
    return parse_exposition(lines, ["sample"])


def read_gpu_samples(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A parquet table ``sample_ts, gpu, util``, as a batch or as a stream."""
    schema = "sample_ts timestamp, gpu string, util double"
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)
