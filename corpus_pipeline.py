"""A training corpus from raw documents: five stages, each one of the numbered operators.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, folder of the tables) and
returns a DataFrame that is written and read again as the next one's ``docs``. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, mixing, near_dedup, quality
from millrace.llm.common import store, table
from millrace.llm.queries import vocabulary
from millrace.session import configure

#: Similarity, in percent, from which documents are near duplicates.
SIMILAR = 80


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    judged = quality.classify(docs, quality.train(docs, table(spark, folder, "labels")))
    return judged.filter("_kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the lines whose template an earlier document has; every document stays."""
    configure(spark)
    return line_dedup.dedup_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    A document is known by its id and its text: of rows that share only an id each has its own verdict. Rows that repeat the id and the text of the one that stays are dropped too. Rows without an id
    cannot be named and stay.
    """
    configure(spark)
    judged = near_dedup.verdicts(docs, percent=SIMILAR)
    gone = judged.filter("not kept").select("doc_id", "text_key").distinct().alias("_gone")
    same = (F.col("_docs.doc_id") == F.col("_gone.doc_id")) & (near_dedup.text_key_of("_docs.text") == F.col("_gone.text_key"))
    left = docs.alias("_docs").join(gone, same, "left_anti")
    # asked of the ids alone, before the join above is run
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    if ids.isEmpty():
        return left
    # of rows that repeat an id, equal texts are copies; their ids are few unless the table is a mixture
    again = _by_id(left, ids, "left_semi").dropDuplicates(["doc_id", "text"])
    return _by_id(left, ids, "left_anti").unionByName(again)


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """A semi or anti join whose names cannot clash with columns of ``docs``."""
    return docs.alias("_docs").join(ids.alias("_ids"), F.col("_docs.doc_id") == F.col("_ids.doc_id"), how)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated to the target share of their source, in a global random order."""
    configure(spark)
    return mixing.mix(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text they decode to."""
    configure(spark)
    names = vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(docs, names), names))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The classifier, densified signatures and merges have no SQL; tests compare each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
