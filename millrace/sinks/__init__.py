"""Sinks (K1-K6). All of them write folders of part files; nothing passes through the driver."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.infer import result_json
from ..operators.requests import request_json

def write_requests(requests: DataFrame, path: str, mode: str = "append") -> None:
    """Convertible request rows as JSON lines (K1)."""
    rows = requests.where(F.col("error").isNull()) if "error" in requests.columns else requests
    rows.select(request_json(rows)).write.mode(mode).text(path)


def write_json_document(
    lines: DataFrame, path: str, order_by: str, line: str = "line",
    prefix: str = "[", suffix: str = "]", mode: str = "errorifexists",
) -> None:
    """JSON texts as one JSON document over ordered part files (K2).

    The parts, concatenated in name order, are a valid document: the sort ranges the rows over
    tasks, the prefix and the suffix stand on lines of their own before the first and after the
    last row, later rows start with a comma. Only the two end positions come to the driver.
    ``order_by`` must be unique.
    """
    ends = lines.agg(F.min(order_by).alias("first"), F.max(order_by).alias("last")).first()
    if ends["last"] is None:
        empty = lines.sparkSession.createDataFrame([(f"{prefix}\n{suffix}",)], "value string")
        empty.coalesce(1).write.mode(mode).text(path)
        return
    key = F.col(order_by)
    first, last = _constant(ends["first"]), _constant(ends["last"])
    text = F.concat(
        F.when(key == first, f"{prefix}\n").otherwise(","),
        line,
        F.when(key == last, f"\n{suffix}").otherwise(""),
    )
    lines.orderBy(order_by).select(text.alias("value")).write.mode(mode).text(path)


def _constant(value):
    if hasattr(value, "asDict"):
        return F.struct(*[F.lit(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


def read_json_document(spark, path: str) -> DataFrame:
    """Elements of a folder written by :func:`write_json_document` as a bare array, one per row."""
    lines = spark.read.text(path).where(~F.col("value").isin("[", "]", ""))
    return lines.select(F.regexp_replace("value", "^,", "").alias("line"))


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stored results as a bare JSON list, without metrics (K3).

    Like every ordered sink this reads its input more than once: pass a stored table, not a lazy
    inference map.
    """
    write_json_document(results.select("seq", result_json()), path, "seq", mode=mode)


def write_envelope(
    results: DataFrame, metrics: dict[str, dict[str, Any]], path: str, mode: str = "errorifexists"
) -> None:
    """Results and metric maps as one envelope document (K4).

    ``metrics`` holds ``vllm_metrics`` (left out when empty), ``gpu_metrics``, ``run_metrics``.
    """
    tail = "".join(
        f',"{name}":{json.dumps(values)}' for name, values in metrics.items() if values
    )
    write_json_document(
        results.select("seq", result_json()), path, "seq",
        prefix='{"results":[', suffix="]" + tail + "}", mode=mode,
    )


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as its own partition folder (K5); a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
