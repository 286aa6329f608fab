"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target share of the mixture over its share of the
input. A document's number of copies is the inverse of the Poisson distribution of that rate at a
number between 0 and 1 hashed from seed and document, so it is the same on any partitioning and a
source's expected size meets its target. Documents are exploded by their counts, and the copies are
shuffled globally by a hash of seed, document and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

#: Up to so many sources the rates are sent to all tasks (a few hundred bytes each).
MAX_BROADCAST_SOURCES = 20_000
#: 13 hexadecimal digits of the hash, which a double holds exactly.
UNIT = float(1 << 52)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(UNIT)


def poisson_table(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, up to where the rest is below 1e-12."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("table")
    )

    def add(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log_p)
        return F.struct(
            log_p.alias("log_p"), total.alias("total"), F.concat(state["table"], F.array(total)).alias("table")
        )

    full = F.aggregate(F.sequence(F.lit(1), last), start, add)["table"]
    return F.when(rate > 0, full).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """source, n_docs, size (code points), weight, rate; the sizes cover all documents.

    ``weights`` are target shares by source, of any total; sources not named get 0 and vanish. By
    default a source's target share grows with its size to the power ``exponent``. The expected
    size of the mixture is that of the input. Null sources form one source, the empty name.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(F.length(text_of(text_column)).cast("long")).alias("size")
    )
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(exponent)))
    else:
        given = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
        raw = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    sizes = store(sizes.withColumn("raw", raw), "sources")
    # one row of totals
    whole = sizes.agg(F.sum("size").alias("all"), F.sum("raw").alias("raw")).first()
    weight = F.col("raw") / F.lit(float(whole["raw"] or 1.0))
    rate = F.when(F.col("size") > 0, F.round(weight * F.lit(float(whole["all"] or 0)) / F.col("size"), 9))
    return sizes.select(
        "source", "n_docs", "size", weight.alias("weight"), F.coalesce(rate, F.lit(0.0)).alias("rate")
    )


def replicate(
    docs: DataFrame,
    rates: DataFrame,
    seed: int,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """The columns of ``docs`` plus ``_copy`` (from 0) and ``_spot``, the place in the mixture.

    Rows stand in the global order of ``_spot``. Rows that repeat an id get the same count. A null
    id is hashed as the empty text. ``_copy`` and ``_spot`` of the input, if any, are replaced.
    """
    table = rates.select(
        F.col("source").alias("_rate_source"), poisson_table(F.col("rate")).alias("_cdf")
    )
    if rates.count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    docs = docs.drop("_copy", "_spot")
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    joined = docs.join(
        table, F.coalesce(F.col(source_column).cast("string"), F.lit("")) == F.col("_rate_source")
    )
    drawn = unit_hash(f"copies-{seed}", ident)
    count = F.size(F.filter("_cdf", lambda p: p <= drawn))
    copies = joined.withColumn("_copies", count).filter("_copies > 0").select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"),
    )
    spot = unit_hash(f"order-{seed}", ident, F.col("_copy"))
    return copies.withColumn("_spot", spot).orderBy("_spot", id_column, "_copy")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    seed: int = 17,
    exponent: float = 0.5,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Documents repeated to their source's rate, in a global random order.

    Gives the columns of ``docs`` and ``_copy``, ``_spot``. A document of an empty source, or with
    count 0, is not in the mixture. A source of only empty texts has no size to reach and gets rate
    0; an empty table gives no rows; null texts have length 0.
    """
    rates = source_rates(docs, weights, exponent, source_column, text_column)
    return replicate(docs, rates, seed, id_column, source_column)
