"""Personal data: pattern matches, and the terms that reveal them by co-occurrence in the corpus.

The protected entities are the matches of fixed patterns (addresses and numbers), each one by its value and all of one
kind together. Document frequencies over the whole corpus tell how much of an entity's information a term gives away:
with P(entity | term) = df(both) / (df(term) + SMOOTHING), PMI = log2(D * P / df(entity)), and
the entity's information is IC = log2(D / df(entity)). The share PMI / IC is near 1 when the term occurs
nowhere else and 0 when it is independent; smoothing lowers it for rare terms. For a value, documents count that have the term near it,
for a kind those that have the term anywhere, in two different texts at least. Every occurrence of a term whose share
reaches a threshold is generalised to its lexical class in the documents that hold the entity; terms that give away nearly all are
removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, store_counted, string_column, text_of, text_slices

#: Words on either side of a match, in its line, that count as near.
WINDOW = 8
#: Share of an entity's information from which a term is generalised, and removed.
GENERALISE_AT, REMOVE_AT = 0.9, 0.99
#: Documents with the term but without the entity that are taken to be there unseen.
SMOOTHING = 0.5
#: Disclosing pairs that are broadcast; with more of them the places of all terms are shuffled.
MAX_BROADCAST_PAIRS = 500_000
#: Words of a document whose terms are handed on in one row.
WORDS_AT_ONCE = 20_000
#: Terms one task counts before it passes the counts on.
TERMS_AT_ONCE = 1 << 19

KINDS = ("email", "ip", "card", "phone")
# What a match takes is never given back, which changes no match: what follows each part begins with another character.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a match of the kind begins with; it begins where a run of these begins, or right behind another match.
BEGINS = {"email": r"[A-Za-z0-9._%+-]", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}
HERE = {k: re.compile(p) for k, p in PATTERNS.items()}
FIRST = {k: re.compile(p if k == "phone" else f"(?<!{BEGINS[k]}){p}") for k, p in PATTERNS.items()}
#: Without this character a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits carry a valid check digit."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in found.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(DIGIT.findall(found))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def matches(kind: str, text: str) -> Iterator[re.Match[str]]:
    """Leftmost matches that do not overlap, in time proportional to the text.

    If no match begins where a run begins, none begins inside it: the rest of the run would have to match the same way.
    """
    at = 0
    while True:
        found = (HERE[kind].match(text, at) if at else None) or FIRST[kind].search(text, at)
        if found is None:
            return
        yield found
        at = found.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    spans = []
    digits = DIGIT.search(text) is not None
    for kind in KINDS:
        if NEEDS[kind] in text and (digits or kind == "email"):
            spans += [(kind, m.start(), m.end()) for m in matches(kind, text) if _valid(kind, m[0])]
    return spans


def entity(kind: str, found: str) -> str:
    """The name under which spellings of one address or number are counted together."""
    return f"{kind}:{found.lower() if kind == 'email' else '.'.join(DIGIT.findall(found)) if kind != 'ip' else found}"


def term_of(word: str) -> str:
    """A word without case and without punctuation around it; empty if nothing else is in it."""
    word = word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def covered_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[bool]]:
    """The words of a text, and which of them a span touches."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    covered = [False] * len(words)
    for _, a, b in spans:
        at = max(bisect_right(starts, a) - 1, 0)
        while at < len(words) and words[at][0] < b:
            covered[at] = covered[at] or words[at][1] > a
            at += 1
    return words, covered


def near_words(text: str, spans: list[tuple[str, int, int]], words: list[tuple[int, int]]) -> dict[int, set[str]]:
    """The entities near each word, by its number: at most ``WINDOW`` words away, in one line."""
    starts = [a for a, _ in words]
    breaks = [m.start() for m in re.finditer("\n", text)]
    found: dict[int, set[str]] = {}
    for kind, a, b in spans:
        name = entity(kind, text[a:b])
        line = bisect_left(breaks, a)
        low = breaks[line - 1] if line else -1
        high = breaks[line] if line < len(breaks) else len(text)
        at, after = bisect_left(starts, a), bisect_left(starts, b)
        for i in range(max(at - WINDOW - 1, 0), min(after + WINDOW, len(words))):
            if low < words[i][0] < high:
                found.setdefault(i, set()).add(name)
    return found


SPOT = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NAMES = pa.list_(pa.string())
TERM = pa.struct([("term", pa.string()), ("entities", NAMES), ("first", NAMES), ("spots", pa.list_(SPOT))])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, and for one with matches, further rows for every ``WORDS_AT_ONCE`` words."""
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = base_spans(text)
            kinds = sorted({kind for kind, *_ in own})
            words, covered = covered_words(text, own) if own else ([], [])
            near = near_words(text, own, words) if own else {}
            entities = [*kinds, *sorted({entity(kind, text[a:b]) for kind, a, b in own})]
            seen: dict[str, set[str]] = {}
            for first in range(0, max(len(words), 1), WORDS_AT_ONCE):
                terms: dict[str, tuple[set[str], list[dict[str, int]]]] = {}
                for k in range(first, min(first + WORDS_AT_ONCE, len(words))):
                    a, b = words[k]
                    if not covered[k] and (term := term_of(text[a:b])):
                        by, spots = terms.setdefault(term, (set(kinds), []))
                        by |= near.get(k, set())
                        spots.append({"start": a, "end": b})
                listed = []
                for t, (by, spots) in terms.items():
                    before = seen.setdefault(t, set())
                    listed.append({"term": t, "entities": sorted(by), "first": sorted(by - before), "spots": spots})
                    before |= by
                head = first == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, 1) for c in ("doc_id", "row", "text_hash")),
                        pa.array([head]),
                        pa.array([[dict(zip(("kind", "start", "end"), s)) for s in own] if head else []], pa.list_(SPAN)),
                        pa.array([entities if head else []], pa.list_(pa.string())),
                        pa.array([listed], pa.list_(TERM)),
                    ],
                    names=["doc_id", "row", "text_hash", "head", "base", "entities", "terms"],
                )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"]
        )

    for batch in batches:
        for _, texts in text_slices(string_column(batch, "text")):
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            terms = pa.array([term_of(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            term = terms.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            document = np.repeat(np.arange(len(lengths)), lengths)
            once = np.unique(document * np.int64(len(terms.dictionary)) + term) % max(len(terms.dictionary), 1)
            for name, n in zip(terms.dictionary.to_pylist(), np.bincount(once, minlength=len(terms.dictionary)).tolist()):
                total[name] += n
            if len(total) >= TERMS_AT_ONCE:
                yield out()
                total.clear()
    yield out()


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What each document holds, stored: doc_id, row (unique), text_hash, head, base, entities, terms.

    ``base`` (spans) and ``entities`` (values as ``kind:value``, and kinds) stand in the one row of a document that is its
    head; ``terms`` are the words outside the spans with their places and the entities that they may disclose, ``first`` those
    of them that no earlier row of the document lists with the term.
    """
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    return store(
        rows.mapInArrow(
            _scan,
            "doc_id long, row long, text_hash long, head boolean, base array<struct<kind:string,start:int,end:int>>, "
            "entities array<string>, "
            "terms array<struct<term:string,entities:array<string>,first:array<string>,spots:array<struct<start:int,end:int>>>>",
        ),
        "scanned",
    )


def disclosures(docs: DataFrame, scanned: DataFrame, text_column: str = "text") -> DataFrame:
    """entity (a value or a kind), term, share of its information that the term gives away."""
    by_term = scanned.select("text_hash", F.explode("terms").alias("t")).select("text_hash", "t.term", "t.first")
    together = (
        # a document lists an entity with a term once, so tasks combine their counts before the shuffle
        by_term.select("text_hash", "term", F.explode("first").alias("entity"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_both"), F.min("text_hash").alias("one"), F.max("text_hash").alias("other"))
        .filter(F.contains("entity", F.lit(":")) | (F.col("one") != F.col("other")))
    )
    entities = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = (
        docs.select(text_of(text_column).alias("text"))
        .mapInArrow(_count_terms, "term string, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n_term"))
    )
    documents = F.lit(float(scanned.filter("head").count()))
    given = F.col("n_both") / (F.col("n_term") + F.lit(SMOOTHING))
    information = F.log2(documents / F.col("n_entity"))
    share = (F.log2(given) + information) / information
    return (
        together.join(entities, "entity")
        .join(terms, "term")
        .select("entity", "term", F.when(information > 0, share).otherwise(F.lit(0.0)).alias("share"))
    )


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row, text_hash, base, terms for every row; terms have start, end and action.

    ``base`` are the pattern matches, ``terms`` the words of the same document that disclose them, each with
    the action ``generalise`` or ``remove``, by start. A null text is empty and has none. Rows count as documents, repeated
    ones too, and get equal answers; an empty table gives no rows, and only the two named columns are read. The time
    grows with the length of a text, whatever it holds, and a long one is handed on in several rows.
    """
    scanned = scan(docs, id_column, text_column)
    action = F.when(F.col("share") >= REMOVE_AT, "remove").otherwise("generalise")
    telling, (n_telling,) = store_counted(
        disclosures(docs, scanned, text_column).filter(F.col("share") >= GENERALISE_AT).select("entity", "term", action.alias("action")),
        "telling",
    )
    if n_telling <= MAX_BROADCAST_PAIRS:
        telling = F.broadcast(telling)
    held = scanned.select("row", F.explode("terms").alias("t")).select(
        "row", "t.term", "t.spots", F.explode("t.entities").alias("entity")
    )
    terms = (
        held.join(telling, ["entity", "term"])
        # a word that discloses two entities takes the stronger action
        .select("row", "action", F.explode("spots").alias("s"))
        .groupBy("row", "s.start", "s.end")
        .agg(F.max("action").alias("action"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )
    heads = scanned.filter("head").select("doc_id", "row", "text_hash", "base")
    return heads.join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array()))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("_text", "_base", "_terms"))):
            edits = [(s["start"], s["end"], f"<{s['kind']}>") for s in base or []]
            for t in terms or []:
                word = (text or "")[t["start"] : t["end"]]
                general = "<number>" if DIGIT.search(word) else "<name>" if word[:1].isupper() else "<word>"
                edits.append((t["start"], t["end"], "" if t["action"] == "remove" else general))
            parts, at = [], 0
            for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
                if a >= at:
                    parts += [text[at:a], new]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if edits else text)
        columns = [pa.array(out, pa.string()) if n == "_text" else batch.column(n) for n in batch.schema.names[:-2]]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The columns of ``docs``, the text with matches masked and disclosing terms generalised or removed."""
    text = F.xxhash64(text_of(text_column))
    found = find(docs, id_column, text_column).dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("base").alias("_base"), F.col("terms").alias("_terms")
    )
    joined = docs.join(found, F.col(id_column).cast("long").eqNullSafe(F.col("_id")) & (text == F.col("_hash")), "left")
    names = [("_text" if c == text_column else c) for c in docs.columns]
    rows = joined.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), "_base", "_terms")
    return rows.mapInArrow(_clean, rows.drop("_base", "_terms").schema).withColumnRenamed("_text", text_column)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of matches of each kind, and the digest and text of the spans."""

    def listed(spans: F.Column, kind: F.Column | None = None) -> F.Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"])), ","
        )

    base = listed(F.col("base"))
    terms = listed(F.col("terms"), F.lit("term"))
    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", *(F.when(x != "", x) for x in (base, terms))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
        (F.size("base") + F.size("terms")).cast("long").alias("n_spans"),
    )
