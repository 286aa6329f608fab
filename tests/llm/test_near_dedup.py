import re
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import near_dedup, queries

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows, percent):
    """rows: (doc_id, text) with distinct ids; every pair with a common shingle is compared."""
    sets = {i: shingles(t) for i, t in rows}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in having[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def answers(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_documents_against_brute_force(spark, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(docs, percent=percent)
    assert answers(got) == brute_force(rows, percent)
    if percent == 85:
        assert sorted(queries.op4_near_dedup(spark, FOLDER).collect()) == sorted(got.collect())


def test_chain_of_edits_whose_hub_does_not_reach_all(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    rows, at = [], list(words)
    rows.append((0, " ".join(at)))
    for i in range(1, 60):  # every text is near the one before it, far from most others
        at = list(at)
        for p in rng.integers(0, 200, 2):
            at[p] = f"x{i}_{p}"
        rows.append((i, " ".join(at)))
    for i in range(60, 120):  # copies of one text with edits of their own
        other = list(words)
        for p in rng.integers(0, 200, 3):
            other[p] = f"y{i}_{p}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(near_dedup.near_duplicates(docs)) == brute_force(rows, 80)


def test_nulls_empty_short_repeated_and_clashing_columns(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "One two", "y"), (5, "one  TWO", None),
        (5, "one  TWO", None), (6, "two one", "z"), (None, "one two", "z"), (7, "a b c d e f", "q"),
        (8, "a b c d e f", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("bands", docs_lit())
    got = sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()),
        key=str,
    )
    assert got == sorted(
        [
            (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
            (5, 1, 4, False), (6, 1, 6, True), (None, 1, 4, None), (7, 2, 7, True), (8, 2, 7, False),
        ],
        key=str,
    )
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit(0)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    other = np.concatenate([base[:34], rng.integers(0, 1 << 63, 6, dtype=np.uint64)])
    a, b = near_dedup.signatures([np.unique(base), np.unique(other)])
    assert abs((a == b).mean() - 34 / 46) < 0.2


def group_with_stragglers():
    """Copies of one text with a few edits each, some of them too many for any link."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        at = list(words)
        for p in rng.integers(0, 150, 2 if i % 3 else 4):
            at[p] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(at)))
    return rows


def test_group_with_stragglers_is_settled_in_two_rounds(spark, monkeypatch):
    rows, stored, store = group_with_stragglers(), [], near_dedup.store
    monkeypatch.setattr(near_dedup, "store", lambda df, label: stored.append(label) or store(df, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(near_dedup.near_duplicates(docs, percent=85)) == brute_force(rows, 85)
    assert stored.count("pairs") == 2


def test_rounds_of_hubs_find_the_same_links(spark, monkeypatch):
    rows = group_with_stragglers()
    monkeypatch.setattr(near_dedup, "CROSSING_EACH", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(near_dedup.near_duplicates(docs, percent=85)) == brute_force(rows, 85)


def test_parity_bits_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (0, 1, 20, 250):
        other = np.concatenate([base[n:], rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        bits = near_dedup.sketch(np.unique(base)) ^ near_dedup.sketch(np.unique(other))
        differ = len(np.setxor1d(base, other))
        assert np.unpackbits(bits.view(np.uint8)).sum() <= differ
        assert n != 1 or np.unpackbits(bits.view(np.uint8)).sum() in (0, 2)


def test_components_of_chains_and_cycles(spark):
    rng = np.random.default_rng(8)
    order = rng.permutation(40).tolist()
    edges = {tuple(sorted(e)) for e in [*zip(order, order[1:]), (50, 51), (51, 52), (50, 52), (60, 61)]}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    found = {r.node: r.root for r in near_dedup.star_components(df).collect()}
    assert found == {**{i: 0 for i in range(1, 40)}, 51: 50, 52: 50, 61: 60}
    assert near_dedup.star_components(df.limit(0)).count() == 0
