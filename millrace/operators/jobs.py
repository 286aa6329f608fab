"""Job-history joins.

Both sides have one row per job id (the sources see to it), so no key is hot. Neither side is assumed to be
small: inner, left and semi joins ask for a sort-merge join, since Spark guesses the size of rows that come out of variants
at a small part of what they take, and would broadcast millions of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jobs import ACTIVE_STATES, MISSING

JOB_COLUMNS = ["job_id", "name", "state", "type", "model", "engine", "elapsed", "submitted"]


def _or_missing(*cols: str | Column) -> Column:
    return F.coalesce(*cols, F.lit(MISSING))


def _listed(joined: DataFrame, state: Column, states: Sequence[str] | None) -> DataFrame:
    rows = joined.select(
        "job_id",
        _or_missing("job_name").alias("name"),
        state.alias("state"),
        F.coalesce("type", F.lit("batch")).alias("type"),
        _or_missing("model").alias("model"),
        _or_missing("engine").alias("engine"),
        _or_missing("elapsed").alias("elapsed"),
        _or_missing("submitted").alias("submitted"),
    )
    if states:
        rows = rows.where(F.col("state").isin([s.upper() for s in states]))
    return rows


def all_jobs(registry: DataFrame, accounting: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Every registered job; unknown to accounting means state UNKNOWN."""
    side = accounting.select("job_id", "state", "elapsed")
    joined = registry.join(side.hint("merge"), "job_id", "left")
    return _listed(joined, F.coalesce("state", F.lit("UNKNOWN")), states)


def active_jobs(registry: DataFrame, accounting: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Registered jobs that accounting reports in an active state."""
    wanted = [s.upper() for s in (states or ACTIVE_STATES)]
    side = accounting.where(F.col("state").isin(wanted)).select("job_id", "state", "elapsed")
    return _listed(registry.join(side.hint("merge"), "job_id"), F.col("state"), None)


def newest_first(jobs: DataFrame) -> DataFrame:
    """By submission text, newest first (L1); an unknown time sorts last. A global sort, for sinks."""
    return jobs.orderBy(F.desc("submitted"), F.col("job_id").try_cast("bigint"))


def job_details(registry: DataFrame, accounting: DataFrame) -> DataFrame:
    """One detail row per job known to either side.

    Name and working folder: registry first. State, partition, nodes and times: accounting only.
    Log paths: accounting, else ``<logs_dir>/<id>.out`` and ``.err``.
    """
    r = registry.withColumn("_reg", F.lit(True))
    a = accounting.withColumn("_acc", F.lit(True))
    joined = r.join(a, "job_id", "full_outer")

    def log(column, suffix):
        return _or_missing(
            column,
            F.when(
                F.col("logs_dir").isNotNull(),
                F.concat(F.rtrim("logs_dir", F.lit("/")), F.lit("/"), "job_id", F.lit(suffix)),
            ),
        )

    return joined.select(
        "job_id",
        _or_missing("job_name", "name").alias("name"),
        F.coalesce("type", F.lit("batch")).alias("type"),
        F.coalesce("state", F.lit("UNKNOWN")).alias("state"),
        _or_missing("model").alias("model"),
        _or_missing("engine").alias("engine"),
        _or_missing("partition").alias("partition"),
        _or_missing("nodes").alias("nodes"),
        _or_missing("submitted").alias("submitted"),
        _or_missing("start").alias("start"),
        _or_missing("elapsed").alias("elapsed"),
        _or_missing("time_limit").alias("time_limit"),
        _or_missing("workspace", "working_dir").alias("working_dir"),
        _or_missing("input").alias("input"),
        _or_missing("output").alias("output"),
        log("stdout", ".out").alias("log_stdout"),
        log("stderr", ".err").alias("log_stderr"),
        F.coalesce("_reg", F.lit(False)).alias("tracked"),
    )


def running_jobs(registry: DataFrame, accounting: DataFrame) -> DataFrame:
    """Accounting rows of registered jobs that are active."""
    active = accounting.where(F.col("state").isin(*ACTIVE_STATES))
    return active.join(registry.select("job_id").hint("merge"), "job_id", "left_semi")


def by_number(jobs: DataFrame) -> DataFrame:
    """Numeric order of ids kept as text."""
    return jobs.orderBy(F.col("job_id").cast("bigint"))
