import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row

from millrace.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def brute_force(rows, longest=3, least=10, absorbed=50, top=2000):
    """Every phrase of every piece counted in one dictionary."""
    counts, sizes = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang or "und" if lang is None else lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts["und" if lang is None else lang, tuple(words[i : i + n])] += 1
    kept = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = []
    for (lang, phrase), a in kept.items():
        if any(
            other[0] == lang and len(other[1]) > len(phrase) and 100 * f >= absorbed * a
            and any(other[1][i : i + len(phrase)] == phrase for i in range(len(other[1]) - len(phrase) + 1))
            for other, f in kept.items()
        ):
            continue
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, k = min((int(Fraction(1000000 * a * a, l * r)), k) for k, (l, r) in enumerate(cuts))
        found.append((lang, -score, -a, " ".join(phrase).encode(), *cuts[k], sizes[lang]))
    out, rank = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, l, r, n, -score))
    return out


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in names) for r in phrases.collocations(docs, **options).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = ["a", "B", "Äa", "é", "x\xa0y", "10", "(c)", *"defgh"]
    rows = []
    for _ in range(120):
        picked = rng.choice(words, int(rng.integers(0, 60)), p=np.arange(12, 0, -1) / 78)
        rows.append(("".join(w + str(rng.choice([" ", "  ", "\t", "\n", ", ", ".", " \r\n"])) for w in picked), str(rng.choice(["en", "und", ""]))))
    return [*rows, ("Q z z z z z z z z z z z z q", None), (None, "en"), ("", None), ("... ,\n", "fr"), ("lonely words", "xx")] + [("New York City", "de")] * 11


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 5}, {"longest": 2}, {"top": 3, "absorbed": 90}])
def test_against_brute_force(spark, corpus, options):
    assert result(spark, corpus, **options) == sorted(brute_force(corpus, **options))


def test_candidates_do_not_depend_on_the_number_of_shards_or_on_how_languages_are_numbered(spark, corpus, monkeypatch):
    want = result(spark, corpus)
    monkeypatch.setattr(phrases, "SHARDS", 1)
    assert result(spark, corpus) == want
    monkeypatch.setattr(phrases, "LANGUAGES", 1)
    monkeypatch.setattr(phrases, "SHARDS", 7)
    monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", 50)
    monkeypatch.setattr(phrases, "COUNTED_AT_ONCE", 20)
    assert result(spark, corpus) == want


def test_counts_are_exact_when_all_hashes_share_a_bit(spark, corpus, monkeypatch):
    want = result(spark, corpus)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "_mix", lambda x: x & np.uint64(3))
    assert result(spark, corpus) == want


def test_products_beyond_64_bits(spark):
    table = spark.createDataFrame(
        [("en", 1, "big", 4_000_000_011), ("en", 1, "data", 3_999_999_979), ("en", 0, "0", 10**11)],
        "lang string, words int, phrase string, n long",
    )
    pairs = spark.createDataFrame([("en", 2, "big data", 3_999_999_971)], table.schema)
    phrases_of = phrases.counted_phrases
    try:
        phrases.counted_phrases = lambda *_: (table, pairs)
        row = phrases.collocations(table, longest=2).first()
    finally:
        phrases.counted_phrases = phrases_of
    want = 1000000 * 3_999_999_971**2 // (4_000_000_011 * 3_999_999_979)
    assert (row.a, row.l, row.r, row.n, row.score) == (3_999_999_971, 4_000_000_011, 3_999_999_979, 10**11, want)


def test_odd_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, None), ("one two", "en")]) == []
    long = "ab cd, " * 60_000
    (row,) = result(spark, [(long, "en")])
    assert row == ("en", 1, "ab cd", 60_000, 60_000, 60_000, 120_000, 1_000_000)
    docs = spark.createDataFrame([Row(text="u v", lang="en", n=1, phrase="p", hash=2, shard="s")] * 10)
    (row,) = phrases.collocations(docs).collect()
    assert (row.phrase, row.a, row.score) == ("u v", 10, 1_000_000)
