"""Job registry and accounting sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jobs as J
from ..functions import variants as V
from . import json_split, jsonl


# Members of a registry entry; the submission time may be a number or a text.
_REGISTRY_MEMBERS = (
    "struct<job_name string, type string, model string, engine string, input string, output string, "
    "logs_dir string, workspace string, submitted_at variant>"
)

# Members of an accounting record behind each column; those of varying type stay variants, and
# capitalised names are looked up one by one, since the others differ from them only in case.
_MEMBERS = {
    "state": {"job_state": "variant", "state": "variant"},
    "name": {"name": "string", "job_name": "string"},
    "partition": {"partition": "string", "Partition": "string"},
    "nodes": {"nodes": "string", "Nodes": "string"},
    "working_dir": {"working_directory": "string", "work_dir": "string", "WorkDir": "string"},
    "stdout": {"stdout_expanded": "string", "standard_output": "string"},
    "stderr": {"stderr_expanded": "string", "standard_error": "string"},
    "start": {"time.start": "variant"},
    "elapsed": {"time.elapsed": "variant"},
    "time_limit": {"time.limit": "variant"},
}
ACCOUNTING_COLUMNS = tuple(_MEMBERS)

# A JSON number other than zero.
_NONZERO_NUMBER = r"^-?(?=[\d.]*[1-9])\d"


def registry_jobs(docs: DataFrame, text: str = "value") -> DataFrame:
    """A registry document ``{job_id: {...}}`` to rows; anything but an object gives none."""
    entry = F.explode(V.parse_object(F.col(text))).alias("job_id", "entry")
    rows = docs.select(entry).where(V.is_object(F.col("entry")))
    members = rows.select("job_id", F.try_variant_get("entry", "$", _REGISTRY_MEMBERS).alias("m"))
    members = J.with_timestamp_text(members, "submitted", F.col("m.submitted_at"))
    kept = ("job_name", "type", "model", "engine", "input", "output", "logs_dir", "workspace")
    return members.select(
        "job_id",
        *[F.col(f"m.{k}").alias(k) for k in kept],
        "submitted",
    )


def accounting_entries(docs: DataFrame, text: str = "value", order_by: str | None = None) -> DataFrame:
    """The ``jobs`` list of accounting payloads as rows ``seq, job``; non-objects are dropped."""
    doc = F.try_parse_json(F.col(text))
    order = F.col(order_by) if order_by else F.lit(0)
    jobs = F.try_variant_get(doc, "$.jobs", V.LIST)
    exploded = docs.select(order.alias("_doc"), F.posexplode(jobs).alias("_pos", "job"))
    return exploded.where(V.is_object(F.col("job"))).select(
        F.struct("_doc", "_pos").alias("seq"), "job"
    )


def accounting_jobs(
    entries: DataFrame, columns: Sequence[str] = ACCOUNTING_COLUMNS, only: DataFrame | None = None
) -> DataFrame:
    """Accounting entries (VARIANT ``job``, order ``seq``) to one typed row per job id.

    Rows without a numeric, non-zero id are step records and are dropped; of several rows for one
    id the last wins (an aggregate over rows dealt by id, so that a task sorts one shuffle partition). Only the members
    behind ``columns`` are taken out of the payload and moved; ``only`` (job_id) drops other jobs
    before the aggregate.
    """
    job = F.col("job")
    job_id = F.try_variant_get(job, "$.job_id", "variant")
    wanted = {k: v for c in columns for k, v in _MEMBERS[c].items()}
    lower = {k: v for k, v in wanted.items() if k[0].islower() and "." not in k}
    times = {k.split(".")[1]: v for k, v in wanted.items() if "." in k}
    fields = [f"{k} {v}" for k, v in lower.items()]
    if times:
        fields.append(f"time struct<{', '.join(f'{k} {v}' for k, v in times.items())}>")
    # one pass over the payload takes the members out; they are formatted for the winners only
    members = entries.where(F.to_json(job_id).rlike(_NONZERO_NUMBER)).select(
        "seq",
        F.try_variant_get(job, "$.job_id", "string").alias("job_id"),
        F.try_variant_get(job, "$", f"struct<{', '.join(fields)}>").alias("m"),
        F.struct(
            F.lit(0).alias("none"),
            *[F.try_variant_get(job, f"$.{k}", v).alias(k) for k, v in wanted.items() if k[0].isupper()],
        ).alias("other"),
    )
    if only is not None:
        members = members.join(only.select("job_id"), "job_id", "left_semi")
    # dealt by id first: combining in the reading tasks would sort all the rows of a file split in each
    latest = members.repartition("job_id").groupBy("job_id").agg(F.max_by(F.struct("m", "other"), "seq").alias("w"))
    # in steps, so that each part is computed once a row
    shown = latest.select("job_id", "w.*")
    if "state" in columns:
        raws = {f"_{k}": F.col(f"m.{k}") for k in ("job_state", "state")}
        shown = shown.withColumns({k: J.current_state(v) for k, v in raws.items()})
        shown = shown.withColumns({k: J.named_state(F.col(k)) for k in raws})
        shown = shown.withColumn("state", F.coalesce(*[J.shown_state(F.col(k)) for k in raws], F.lit("UNKNOWN")))
    if "start" in columns:
        shown = J.with_timestamp_text(shown, "start", F.col("m.time.start"))
    if "elapsed" in columns:
        shown = shown.withColumn("_elapsed", V.number_or_null(F.col("m.time.elapsed")))
        shown = shown.withColumn("elapsed", J.duration_text(F.col("_elapsed")))
    if "time_limit" in columns:
        shown = shown.withColumn("_minutes", J.limit_minutes(F.col("m.time.limit")))
        shown = shown.withColumn("time_limit", J.minutes_text(F.col("_minutes")))

    def text(column):
        names = [f"other.{k}" if k[0].isupper() else f"m.{k}" for k in _MEMBERS[column]]
        return F.coalesce(*[F.nullif(J.strip(F.col(n)), F.lit("")) for n in names])

    texts = {c: text(c) for c in columns if c not in shown.columns}
    return shown.select("job_id", *[texts[c].alias(c) if c in texts else c for c in columns])


def read_registry(spark: SparkSession, path, split_over: int = jsonl.SPLIT_OVER) -> DataFrame:
    """Registry files; one larger than ``split_over`` bytes is cut at its members by many tasks."""
    wanted = [path] if isinstance(path, str) else list(path)
    small = spark.read.text(wanted, wholetext=True).where(F.col("_metadata.file_size") <= split_over)
    rows = registry_jobs(small)
    lengths = json_split.large_files(spark, wanted, split_over)
    if not lengths:
        return rows
    members = json_split.large_members(spark, lengths)
    # a repeated id keeps its last entry
    last = members.groupBy("file", F.json_object_keys("value")[0].alias("job_id")).agg(F.max_by("value", "number").alias("value"))
    return rows.unionByName(registry_jobs(last))


def read_accounting(
    spark: SparkSession, path, columns: Sequence[str] = ACCOUNTING_COLUMNS, split_over: int = jsonl.SPLIT_OVER
) -> DataFrame:
    """Accounting files; the job list of one larger than ``split_over`` bytes is cut by many tasks."""
    wanted = [path] if isinstance(path, str) else list(path)
    small = spark.read.text(wanted, wholetext=True).where(F.col("_metadata.file_size") <= split_over)
    docs = small.select("value", json_split.comparable(F.col("_metadata.file_path")).alias("file"))
    order = "struct<_doc:string,_pos:bigint>"
    entries = accounting_entries(docs, order_by="file").select(F.col("seq").cast(order).alias("seq"), "job")
    lengths = json_split.large_files(spark, wanted, split_over)
    if lengths:
        items, _ = json_split.large_items(spark, lengths, "jobs")
        if items is not None:
            jobs = items.where(F.col("error").isNull() & V.is_object(F.col("item")))
            entries = entries.unionByName(jobs.select(F.col("seq").cast(order).alias("seq"), F.col("item").alias("job")))
    return accounting_jobs(entries, columns)
