"""A batch run: requests, model calls, stored results, metrics."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infer as INF
from ..operators import metrics as M
from ..operators import resolve as RES
from ..session import configure
from ..sources import jsonl
from ..sources.catalog import ModelSpec


@dataclass(frozen=True)
class RunOutput:
    """Stored results (read back from the table) and the run's metrics row with its success counts."""

    results: DataFrame
    metrics: DataFrame
    elapsed_sec: float


def results_of(
    requests: DataFrame, model: ModelSpec, factory: INF.CompleterFactory,
    defaults: dict[str, Any] | None = None, max_retries: int = 3, retry_delay: float = 1.0,
    partitions: int | None = None, concurrency: int = 1,
) -> DataFrame:
    """Requests to result rows. Lazy, and every evaluation calls the model."""
    resolved = RES.resolve_requests(requests, model, defaults)
    called = INF.infer(resolved, factory, max_retries, retry_delay, partitions, concurrency)
    return INF.shape_results(called, model.engine_name)


def run_batch(
    spark: SparkSession, source: str | list[str] | DataFrame, output_path: str, model: ModelSpec,
    factory: INF.CompleterFactory, defaults: dict[str, Any] | None = None, max_retries: int = 3,
    retry_delay: float = 1.0, partitions: int | None = None, warm: bool = True,
    concurrency: int = 1, slices: int = 1,
    on_save_point: Callable[[int], None] | None = None,
    input_handler: Callable[..., DataFrame] | None = None,
    output_handler: Callable[[DataFrame], None] | None = None,
) -> RunOutput:
    """Run JSONL files or a request table through the model.

    The results are written once as a parquet table and read back before anything is computed from
    them, so a lost executor or a second action never calls the model again for stored rows.

    With several ``slices``, or on a path where such a run was begun, the requests are stored first, each with a number of its
    own, and every slice of them is a save point: its results are written to a folder that counts from the moment Spark
    commits it. A run that is started again, with any number of slices, leaves out the
    requests that a save point has answered, so each is answered once; what a cut run left uncommitted is deleted.
    A manifest holds the model, the call settings and a digest of the requests; another run on the same path is refused.
    ``on_save_point(n)`` is called with the number of save points after each one.

    ``input_handler(source)`` makes the request table of any other source; ``output_handler`` gets
    the stored results, to export them in another form (K6).
    """
    configure(spark)
    model.require_available()
    if input_handler is not None:
        requests = input_handler(source)
    elif isinstance(source, DataFrame):
        requests = source
    else:
        wanted = [source] if isinstance(source, str) else list(source)
        if len(jsonl.existing_paths(spark, wanted)) < len(wanted):
            raise FileNotFoundError(f"Input file not found: {source}")
        requests = RES.requests_from_lines(jsonl.read_jsonl(spark, wanted))
    if warm:
        INF.warm_up(factory, model.engine_name)
    started = time.perf_counter()
    calls = (model, factory, defaults, max_retries, retry_delay, partitions, concurrency)
    folder = output_path.rstrip("/")
    if slices == 1 and not jsonl.existing_paths(spark, [f"{folder}/{MANIFEST}"]):
        results_of(requests, *calls).write.mode("errorifexists").parquet(output_path)
        stored = spark.read.parquet(output_path)
    else:
        settings = {"model": model.engine_name, "defaults": defaults or {}, "max_retries": max_retries}
        stored = _in_slices(spark, requests, folder, settings, calls, slices, on_save_point)
    elapsed = time.perf_counter() - started
    if output_handler is not None:
        output_handler(stored)
    metrics = M.run_metrics(M.metric_inputs(stored), elapsed, summary=True)
    return RunOutput(stored, metrics, elapsed)


#: Names below the folder of a run in slices. Spark leaves out names that begin like these.
MANIFEST, REQUESTS, SAVE_POINT = "_run", "_requests", "save="


def _digest(requests: DataFrame) -> dict[str, str]:
    """Number of requests, and a sum over their contents that does not depend on their order."""
    rows = requests.select(*sorted(requests.columns))
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "seq")))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("s")).first()
    return {"requests": str(row["n"]), "digest": str(row["s"])}


def _in_slices(
    spark: SparkSession, requests: DataFrame, folder: str, settings: dict[str, Any], calls: tuple, slices: int,
    on_save_point: Callable[[int], None] | None,
) -> DataFrame:
    manifest = json.dumps({**settings, **_digest(requests)}, sort_keys=True, default=str)
    if jsonl.existing_paths(spark, [f"{folder}/{MANIFEST}/_SUCCESS"]):
        held = spark.read.text(f"{folder}/{MANIFEST}").first()[0]
        if held != manifest:
            raise ValueError(f"{folder} holds another run: {held}, not {manifest}")
    else:
        # the manifest comes last: without it the stored requests are written anew
        numbered = requests.withColumn(INF.REQUEST_KEY, F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{folder}/{REQUESTS}")
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{MANIFEST}")
    fixed = spark.read.parquet(f"{folder}/{REQUESTS}")
    saved, begun = _save_points(spark, folder)
    for path in begun:
        _delete(spark, path)
    todo = fixed
    if saved:
        answered = spark.read.parquet(*saved).select(INF.REQUEST_KEY)
        todo = fixed.join(answered, INF.REQUEST_KEY, "left_anti")
    first = max((int(p.rsplit(SAVE_POINT, 1)[1]) for p in saved), default=-1) + 1
    slice_of = F.pmod(F.xxhash64(INF.REQUEST_KEY), F.lit(slices))
    for k in range(slices):
        path = f"{folder}/{SAVE_POINT}{first + k}"
        part = todo.where(slice_of == k)
        if saved and part.isEmpty():
            continue
        results_of(part, *calls).write.parquet(path)
        saved.append(path)
        if on_save_point is not None:
            on_save_point(len(saved))
    return spark.read.parquet(*saved).drop(INF.REQUEST_KEY)


def _save_points(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """The folders of slices that are committed, and of those that are not."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{SAVE_POINT}*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = [f.getPath().toString() for f in fs.globStatus(pattern) or []]
    saved = [p for p in paths if jsonl.existing_paths(spark, [f"{p}/_SUCCESS"])]
    return saved, [p for p in paths if p not in saved]


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run_summary(*metric_rows: DataFrame) -> DataFrame:
    """One-row metric tables side by side, such as run, server and GPU metrics."""
    return M.combine(metric_rows, [])
