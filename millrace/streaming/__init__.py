"""Structured Streaming forms of the incremental behaviours."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sinks
from ..functions import paths as P
from ..functions.text import strip
from ..operators.infer import CompleterFactory
from ..operators.resolve import requests_from_lines
from ..plans.run import results_of
from ..session import configure
from ..sources import jsonl
from ..sources.catalog import ModelSpec


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New JSONL files of a folder as a stream of content lines."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(folder).select(
        P.plain_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        strip(F.col("value")).alias("line"),
    )
    return lines.where(jsonl.is_content(F.col("line")))


def stream_requests(
    spark: SparkSession, folder: str, output_path: str, checkpoint: str, model: ModelSpec,
    factory: CompleterFactory, defaults: dict[str, Any] | None = None, max_retries: int = 3,
    retry_delay: float = 1.0, files_per_trigger: int | None = None, strict: bool = True,
) -> StreamingQuery:
    """Process what is new in a folder and stop.

    Each micro-batch calls the model once per request and lands in its own output folder, which a
    retried batch replaces; work done is durable per batch instead of every n items.
    """
    configure(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        good = batch.where(jsonl.line_valid(F.col("line"), strict))
        items = good.withColumn("item", F.try_parse_json("line")).withColumn(
            "seq", F.struct("source_file", "block", F.monotonically_increasing_id().alias("row"))
        )
        requests = requests_from_lines(items.where(F.col("item").isNotNull()))
        results = results_of(requests, model, factory, defaults, max_retries, retry_delay)
        sinks.append_batch(results, output_path, batch_id)

    return (
        stream_lines(spark, folder, files_per_trigger)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_gauges(
    samples: DataFrame, ts: str, value: str, window: str = "1 hour", watermark: str = "1 hour",
    keys: tuple[str, ...] = (), accuracy: int = 10000,
) -> DataFrame:
    """Gauge statistics per time window (T2), for a stream or a batch.

    Quantiles are the bounded-state kind: an exact one would keep every value of a window as state.
    """
    v = F.col(value)
    event_time = F.col(ts).cast("timestamp")
    return (
        samples.withColumn("_ts", event_time)
        .withWatermark("_ts", watermark)
        .groupBy(F.window("_ts", window).alias("w"), *keys)
        .agg(
            F.count(v).alias("samples"),
            F.avg(v).alias("avg_value"),
            F.max(v).alias("peak_value"),
            F.stddev_pop(v).alias("stddev_value"),
            F.percentile_approx(v, [0.5, 0.95], accuracy).alias("approx_p50_p95"),
        )
        .select(
            F.col("w.start").alias("window_start"), *keys,
            "samples", "avg_value", "peak_value", "stddev_value", "approx_p50_p95",
        )
    )
