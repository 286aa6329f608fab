"""Line deduplication with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line descends by its number of tokens and then by its leading tokens, where
tokens that hold digits count as a variable field. Leaves that only one document reaches need no
further look. Inside a leaf a line offers several templates: itself with its number fields
masked, and, if it is long enough, itself with one stretch of the remaining tokens left open. A line that is
mostly numbers, such as a row of a table, offers its exact tokens alone. Lines
that differ in the fields of one stretch meet in the template that leaves it open. A template found
in several documents is dropped from all of them but the first, so one copy of every passage stays.

Only hashes of lines are shuffled to find templates; texts move once, when dropped lines are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

FIELD = "<*>"
#: Leading tokens that choose the branch below the token count.
LEADING = 3
#: Lines with fewer tokens are no templates: too short to tell boilerplate from chance.
MIN_TOKENS = 3
#: Lines with fewer tokens have no open stretch, so that most of a template is fixed.
MIN_OPEN_TOKENS = 12
#: Share of tokens without digits from which a line's numbers are fields; below it they are its content.
MIN_FIXED = 0.5
STRETCHES = 8
SPACES = r"[\x20\t\x0B\f\r]+"


def _tokens(line: Column) -> Column:
    # a token with a digit in it; the first part takes no digits, so nothing is tried twice
    number = r"[^\x20\t\x0B\f\r0-9]*+[0-9][^\x20\t\x0B\f\r]*+"
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, number, FIELD)).otherwise(line)
    return F.split(F.btrim(masked, F.lit(" \t\x0b\f\r")), SPACES)


def _templates(tokens: Column, line: Column) -> Column:
    """The hash of all tokens and, for a long line, those of all but one stretch of the tail.

    If too few tokens are fixed, only the hash of the tokens with their numbers.
    """
    n = F.size(tokens)
    # stretch k is tokens LEADING + k * tail / STRETCHES up to the next stretch
    cuts = [(F.floor((n - LEADING) * k / STRETCHES) + LEADING).cast("int") for k in range(STRETCHES + 1)]
    open_ = [
        F.xxhash64(F.lit(k), n, F.slice(tokens, 1, cuts[k]), F.slice(tokens, cuts[k + 1] + 1, n))
        for k in range(STRETCHES)
    ]
    whole = F.array(F.xxhash64(F.lit(-1), tokens))
    fixed = F.size(F.filter(tokens, lambda t: t != FIELD))
    exact = F.array(F.xxhash64(F.lit(-2), F.split(F.btrim(line, F.lit(" \t\x0b\f\r")), SPACES)))
    return (
        F.when(fixed < MIN_FIXED * n, exact)
        .when(n >= MIN_OPEN_TOKENS, F.concat(whole, F.array(*open_)))
        .otherwise(whole)
    )


def lines_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, pos, leaf, templates (hashes) of every line long enough, stored.

    A document is known by its id and the hash of its text: rows repeating both are one document.
    """
    text = text_of(text_column)
    lines = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    ).filter("line <> ''")
    parsed = lines.select("doc_id", "text_hash", "pos", "line", _tokens(F.col("line")).alias("tokens")).filter(
        F.size("tokens") >= MIN_TOKENS
    )
    return store(
        parsed.select(
            "doc_id",
            "text_hash",
            "pos",
            F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEADING)).alias("leaf"),
            _templates(F.col("tokens"), F.col("line")).alias("templates"),
        ),
        "lines",
    )


def recurring(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """template, n_docs, home: templates of at least ``min_docs`` documents and the first of these.

    The first document has the smallest id; null ids come last.
    """
    document = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    return (
        lines.select(F.explode("templates").alias("template"), document.alias("document"))
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("n_docs"), F.min("document").alias("home"))
        .filter(F.col("n_docs") >= min_docs)
    )


def dropped_lines(docs: DataFrame, min_docs: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, dropped: the places (from 0) of the lines to take out of each document."""
    lines = lines_of(docs, id_column, text_column)
    document = F.struct("doc_id", "text_hash")
    shared = (
        lines.groupBy("leaf")
        .agg(F.min(document).alias("one"), F.max(document).alias("other"))
        .filter(F.col("one") != F.col("other"))
        .select("leaf")
    )
    inside = store(lines.join(shared, "leaf").select("doc_id", "text_hash", "pos", "templates"), "leaves")
    known = recurring(inside, min_docs)
    return (
        inside.select("doc_id", "text_hash", "pos", F.explode("templates").alias("template"))
        .join(known, "template")
        .filter(~(F.col("doc_id").eqNullSafe(F.col("home.doc_id")) & (F.col("text_hash") == F.col("home.text_hash"))))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("dropped"))
    )


def dedup_lines(docs: DataFrame, min_docs: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` with recurring lines taken out of the text, and _n_lines, _n_dropped.

    Every row stays, even if no line of it does: its text is then empty. A null or empty text has
    one empty line, which stays, and comes back as it was. The first document with a template
    keeps all lines of it, and so do rows that repeat that document's id and text. Lines that repeat
    only inside one document stay. ``_n_lines`` and ``_n_dropped`` of the input are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped")
    dropped = dropped_lines(docs, min_docs, id_column, text_column).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("dropped").alias("_dropped")
    )
    text = text_of(text_column)
    joined = docs.join(
        dropped,
        F.col(id_column).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")),
        "left",
    )
    lines = F.split(text, "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    changed = F.when(F.col("_dropped").isNull(), F.col(text_column)).otherwise(left)
    kept = [(changed.alias(c) if c == text_column else F.col(f"`{c}`")) for c in docs.columns]
    return joined.select(
        *kept,
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("_n_dropped"),
    )
