import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_score, queries

FOLDER = "/root/testdata/sf0.01"
K, END = lm_score.ORDER, lm_score.END


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def symbols(text):
    return [*" ".join(words(text)).encode(), END]


class Plain:
    """Prediction by partial matching with dictionaries, one symbol after another."""

    def __init__(self, texts, least=1):
        seen = [defaultdict(Counter) for _ in range(K + 1)]
        for text in texts:
            s = [END] * K + symbols(text)
            for i in range(K, len(s)):
                for j in range(K + 1):
                    seen[j][tuple(s[i - j : i])][s[i]] += 1
        self.total = sum(seen[0][()].values())
        self.seen = [{c: {x: n for x, n in d.items() if n >= least} for c, d in level.items()} for level in seen]
        self.seen = [{c: d for c, d in level.items() if d} for level in self.seen]

    def pruned(self, context):
        """How often the context was followed by a symbol whose node was pruned."""
        kept = sum(self.seen[len(context)][context].values())
        every = self.seen[len(context) - 1].get(context[:-1], {}).get(context[-1], kept) if context else self.total
        return max(0, every - kept)

    def distribution(self, context):
        p, scale, excluded = {}, 1.0, set()
        for j in range(K, -1, -1):
            found = self.seen[j].get(tuple(context[len(context) - j :]))
            if found is None:
                continue
            left = {x: n for x, n in found.items() if x not in excluded}
            escape = len(left) + self.pruned(tuple(context[len(context) - j :]))
            if escape:
                whole = sum(left.values()) + escape
                p |= {x: scale * n / whole for x, n in left.items()}
                scale *= escape / whole
            excluded |= set(found)
        rest = 257 - len(excluded)
        return {x: p.get(x, scale / rest) for x in range(257)}

    def log10(self, text):
        s = [END] * K + symbols(text)
        return sum(math.log10(self.distribution(s[i - K : i])[s[i]]) for i in range(K, len(s)))


TEXTS = ["The cat sat on the mat", "the cat  ran\nto the hat", "Éa öß thé", "", None, "aaaa aaab aaac", "the the the"]


@pytest.mark.parametrize("share", [2.0**-21, 0.02])
def test_scores_against_plain_model(spark, share):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, row string")
    trained = TEXTS[1:4] + TEXTS[5:]
    least = max(1, sum(len(symbols(t)) for t in trained) * share)
    plain = Plain(trained, least)
    inside = F.col("doc_id").isin([1, 2, 3, 5, 6])
    got = lm_score.score(docs, inside, head_words=2, min_share=share).collect()
    counts = Counter(w for t in trained for w in [*words(t), END])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        tokens = [*words(TEXTS[r.doc_id % len(TEXTS)]), END]
        assert r.score == pytest.approx(plain.log10(TEXTS[r.doc_id % len(TEXTS)]), abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert r.base_score == pytest.approx(base, abs=1e-9)


def test_probabilities_of_all_symbols_add_up_to_one():
    plain = Plain(TEXTS)
    nodes = []
    for level in plain.seen:
        packed = sorted((int(sum(x << (9 * k) for k, x in enumerate([s, *reversed(c)]))), n) for c, d in level.items() for s, n in d.items())
        nodes.append((np.array([g for g, _ in packed]), np.array([n for _, n in packed])))
    trie = lm_score.Trie(nodes, plain.total)
    for context in ([END] * K, list(b" the "), list(b"zzzzz"), list(b"zzthe"), [END, END, END, 97, 97]):
        packed = sum(x << (9 * (K - k)) for k, x in enumerate(context))
        p = 10 ** trie.log10(packed + np.arange(257))
        assert p.sum() == pytest.approx(1)
        assert p == pytest.approx(np.array([plain.distribution(context)[x] for x in range(257)]))


def test_query_base_score_and_held_out_gain(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in rows}
    counts = Counter(w for i, t in rows.items() if not out[i] for w in [*words(t), END])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op6_lm_score(spark, FOLDER).collect()}
    assert got.keys() == rows.keys()
    for i, r in got.items():
        tokens = [*words(rows[i]), END]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(tokens), n)
        assert r.n_known == sum(t in counts for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
    held = [r for r in queries.op6_lm_score(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(257)) and got[None].n_tokens == 1
    assert got[1].n_known == 0 and got[1].train_tokens == 0
    assert lm_score.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("head_grams", [0, 8, 1 << 21])
def test_looked_up_grams_against_plain_model(spark, head_grams):
    texts = TEXTS + ["cat hat xyz", "zzz \x7f the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Plain(TEXTS[1:4] + TEXTS[5:])
    got = lm_score.score(docs, F.col("doc_id").isin([1, 2, 3, 5, 6]), head_grams=head_grams).collect()
    for r in got:
        assert r.score == pytest.approx(plain.log10(texts[r.doc_id]), abs=1e-9)
    assert len(got) == len(texts)


def test_nodes_seen_once_count_in_a_large_corpus(spark):
    """More than 2 ** 22 training symbols, where a share of 2 ** -22 would drop what is seen once."""
    filler, many = "abcabcabd " * 5000, 90
    rare = ["quick zebu", "the fjord"]
    once = spark.createDataFrame(list(enumerate(rare)) + [(2, "quick fjord zebra")], "doc_id long, text string")
    docs = spark.range(3, many + 3, 1, 8).select(F.col("id").alias("doc_id"), F.lit(filler).alias("text")).union(once)
    seen = [Counter() for _ in range(K + 1)]
    weights = [(filler, many)] + [(t, 1) for t in rare]
    assert sum(len(symbols(t)) * n for t, n in weights) > 2**22
    for text, n in weights:
        s = [END] * K + symbols(text)
        for j in range(K + 1):
            for gram, times in Counter(tuple(s[i - j : i + 1]) for i in range(K, len(s))).items():
                seen[j][gram] += n * times
    plain = Plain([])
    plain.seen = [defaultdict(dict) for _ in seen]
    for level, grams in zip(plain.seen, seen):
        for gram, n in grams.items():
            level[gram[:-1]][gram[-1]] = n
    plain.seen = [dict(level) for level in plain.seen]
    plain.total = sum(seen[0].values())
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") != 2, head_grams=16).collect()}
    for i, text in enumerate([*rare, "quick fjord zebra"]):
        assert got[i] == pytest.approx(plain.log10(text), abs=1e-9)
