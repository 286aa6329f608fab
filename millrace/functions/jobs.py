"""Normalisers for job accounting values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import variants as V
from .text import strip

MISSING = "--"

# Job states that count as active.
ACTIVE_STATES = ("RUNNING", "PENDING")


def current_state(raw: Column) -> Column:
    """The part of a state payload that names the state: a member of ``{"current": ...}``, or all of it."""
    lower, upper = (F.try_variant_get(raw, f"$.{k}", "variant") for k in ("current", "CURRENT"))
    return F.when(V.is_object(raw), F.when(V.truthy(lower), lower).otherwise(upper)).otherwise(raw)


def named_state(current: Column) -> Column:
    """A state that is a string or a list's first entry; NULL when empty or other."""
    first = F.coalesce(
        F.try_variant_get(current, "$[0]", "string"),
        F.when(V.kind(F.try_variant_get(current, "$[0]", "variant")) == "null", "NONE"),
    )
    return F.when(V.kind(current) == "string", current.cast("string")).otherwise(first)


def shown_state(name: Column) -> Column:
    """Upper-cased state; NULL when blank."""
    return F.when(strip(name) != "", F.upper(name))


def state_text(current: Column) -> Column:
    """Upper-cased state from a string or a list's first entry; NULL when blank, empty or other."""
    return shown_state(named_state(current))


def job_state(job: Column) -> Column:
    """State of an accounting entry (X12): ``job_state`` first, then ``state``."""
    raws = [F.try_variant_get(job, f"$.{k}", "variant") for k in ("job_state", "state")]
    return F.coalesce(*[state_text(current_state(r)) for r in raws], F.lit("UNKNOWN"))


def first_text(*values: Column, default: str | None = MISSING) -> Column:
    """First value that is not blank, trimmed."""
    options = [F.nullif(strip(v.cast("string")), F.lit("")) for v in values]
    return F.coalesce(*options, F.lit(default)) if default is not None else F.coalesce(*options)


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def epoch_text(seconds: Column) -> Column:
    """Positive epoch seconds as a timestamp text in the session zone."""
    return F.when(seconds > 0, _stamp(F.timestamp_seconds(F.floor(seconds)))).otherwise(MISSING)


def dashed(text: Column) -> Column:
    """ISO-8601 text, trimmed and with dashes in its date."""
    return F.regexp_replace(strip(text), r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")


def dashed_text(text: Column) -> Column:
    """ISO-8601 text from :func:`dashed` as a timestamp text in the session zone."""
    parsed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2})"), F.try_to_timestamp(text))
    return F.coalesce(_stamp(parsed), F.lit(MISSING))


def iso_text(text: Column) -> Column:
    """ISO-8601 text as a timestamp text in the session zone."""
    return dashed_text(dashed(text))


def either_text(seconds: Column, text: Column) -> Column:
    """Timestamp text of a value that may be epoch seconds or ISO text."""
    return F.when(seconds > 0, epoch_text(seconds)).otherwise(
        F.when(text.isNull(), MISSING).otherwise(iso_text(text))
    )


def timestamp_text(value: Column) -> Column:
    """Timestamp text of a JSON value: an epoch number or an ISO string."""
    return either_text(V.number_or_null(value), value.cast("string"))


def with_timestamp_text(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """:func:`timestamp_text` as a column ``name``, in steps, so that each part is computed once a row."""
    rows = rows.withColumn("_seconds", V.number_or_null(value))
    rows = rows.withColumn("_dashed", F.when(F.coalesce(F.col("_seconds") <= 0, F.lit(True)), dashed(value.cast("string"))))
    text = F.when(F.col("_dashed").isNull(), MISSING).otherwise(dashed_text(F.col("_dashed")))
    shown = F.when(F.col("_seconds") > 0, epoch_text(F.col("_seconds"))).otherwise(text)
    return rows.withColumn(name, shown).drop("_seconds", "_dashed")


def _two_digits(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS`` (X15); hours may pass 99."""
    s = F.floor(seconds).cast("bigint")
    parts = (F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(seconds > 0, F.concat_ws(":", *[_two_digits(p) for p in parts])).otherwise(MISSING)


def minutes_text(minutes: Column) -> Column:
    """Minutes as ``HH:MM:00``."""
    m = F.floor(minutes).cast("bigint")
    text = F.concat_ws(":", _two_digits(F.floor(m / 60)), _two_digits(m % 60), F.lit("00"))
    return F.when(minutes > 0, text).otherwise(MISSING)


def limit_minutes(limit: Column) -> Column:
    """Minutes of a limit that is a number or ``{set, infinite, number}``; NULL if there is none."""
    inner = F.try_variant_get(limit, "$.number", "variant")
    flags = [F.try_variant_get(limit, f"$.{k}", "variant") for k in ("set", "infinite")]
    return F.when(
        V.is_object(limit),
        F.when(V.truthy(flags[0]) & ~V.truthy(flags[1]), V.number_or_null(inner)),
    ).otherwise(V.number_or_null(limit))


def elapsed_seconds(text: Column) -> Column:
    """``[D-]HH:MM:SS`` to seconds (X17); anything else is 0."""
    pattern = r"^\s*(?:([+-]?\d+)\s*-)?\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+)\s*$"
    days, hours, minutes, seconds = (
        F.regexp_extract(text, pattern, i).try_cast("bigint") for i in (1, 2, 3, 4)
    )
    total = F.coalesce(days, F.lit(0)) * 86400 + hours * 3600 + minutes * 60 + seconds
    return F.coalesce(total.cast("double"), F.lit(0.0))


def gigabytes(text: Column) -> Column:
    """``80GB`` to 80 (X19); NULL when malformed."""
    return F.regexp_extract(text, r"^(\d+)GB$", 1).try_cast("int")
