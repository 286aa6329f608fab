"""Conversion reports (A8, A9). Each is one aggregate over the converted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conversion_report(converted: DataFrame, *keys: str) -> DataFrame:
    """total, successful and failed rows, per key if keys are given."""
    ok = F.col("error").isNull()
    counts = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful_conversions"),
        F.count_if(~ok).alias("failed_conversions"),
    ]
    return converted.groupBy(*keys).agg(*counts) if keys else converted.agg(*counts)


def document_report(items: DataFrame, converted: DataFrame) -> DataFrame:
    """One row per JSON document: success, error, and how its items fared.

    ``items`` come from ``sources.jsonl``: a document that could not be used is one row with an
    error there. It has no items and no success; failed items alone do not make a document fail.
    ``converted`` holds the conversions of the same items, with their ``seq``.
    """
    documents = items.groupBy("source_file").agg(
        F.count_if(F.col("error").isNull()).alias("total_items"), F.max("error").alias("error")
    )
    ok = F.col("error").isNull()
    fared = (
        converted.groupBy(F.col("seq.source_file").alias("_file"))
        .agg(F.count_if(ok).alias("_good"), F.count_if(~ok).alias("_bad"))
    )
    usable = F.col("error").isNull()
    return documents.join(fared, F.col("source_file") == F.col("_file"), "left").select(
        "source_file",
        usable.alias("success"),
        "error",
        "total_items",
        F.when(usable, F.coalesce("_good", F.lit(0))).otherwise(0).alias("successful_conversions"),
        F.when(usable, F.coalesce("_bad", F.lit(0))).otherwise(0).alias("failed_conversions"),
    )


def vision_report(converted: DataFrame, *keys: str) -> DataFrame:
    """found, converted, skipped and failed images.

    The files behind the last two counts are a table of their own, see :func:`image_issues`; a
    list inside one row would grow with the data.
    """
    status = F.col("status")
    counts = [
        F.count(F.lit(1)).alias("found"),
        F.count_if(status == "converted").alias("converted"),
        F.count_if(status == "skipped_too_large").alias("skipped_too_large"),
        F.count_if(status == "failed").alias("failed"),
    ]
    return converted.groupBy(*keys).agg(*counts) if keys else converted.agg(*counts)


def image_issues(converted: DataFrame, limit: int) -> DataFrame:
    """One row per image that was not converted: path, size, limit and reason."""
    return converted.where(F.col("status") != "converted").select(
        "path",
        F.col("length").alias("size"),
        F.lit(limit).cast("bigint").alias("limit"),
        "status",
        "error",
    )
