import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import exact_dedup as X


def brute_force(rows):
    groups = defaultdict(list)
    for i, text in rows:
        normal = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(normal.encode()).hexdigest()].append((-len(text or ""), i is None, i))
    return {
        (g[2], min(gs)[2], len(gs), sha) for sha, gs in groups.items() for g in gs
    }


def test_odd_rows(spark):
    rows = [
        (3, "a b", "x"), (1, "ab", "x"), (2, "a\tb ", None), (4, None, "x"), (5, " \n", "y"), (6, "", "y"),
        (7, "a b", "z"), (None, "uniq", "z"), (8, "é" * 200_000, "z"), (None, "a b  ", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string").withColumn("kept", F.lit(1))
    got = X.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_force([r[:2] for r in rows])
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) and len(got) == len(rows)
    assert X.exact_dedup(docs.limit(0)).count() == 0


def test_rows_that_repeat_id_and_text_keep_one(spark):
    docs = spark.createDataFrame([(1, "x")] * 5 + [(2, "x")], "doc_id long, text string")
    got = X.exact_dedup(docs).collect()
    assert [r.kept for r in got].count(True) == 1 and {r.keep_id for r in got} == {1} and got[0].group_size == 6


def test_hot_digest_over_many_buckets_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(X, "DIGESTS_PER_BUCKET", 16)
    monkeypatch.setattr(X, "COMBINED_AT_ONCE", 8)
    docs = spark.range(0, 3000, 1, 7).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("text")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = X.exact_dedup(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute_force(rows)


def test_index_takes_deletions_and_further_rows(spark):
    def docs(*rows):
        return X.digests(spark.createDataFrame(list(rows), "doc_id long, text string"))

    def live(index):
        return {(r.sha.hex()[:8], r.live, r.keep_id) for r in index.entries.collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()[:8]

    index = X.CuckooIndex.sized_for(10).insert(docs((1, "a"), (2, "a"), (3, "b")))
    index = index.insert(docs((4, "b "), (5, "c")))
    assert live(index) == {(sha("a"), 2, 1), (sha("b"), 2, 4), (sha("c"), 1, 5)}
    index = index.delete(docs((5, "c"), (2, "a"), (9, "never there")))
    assert live(index) == {(sha("a"), 1, 1), (sha("b"), 2, 4)}
    found = {r.doc_id: r.live for r in index.assign(docs((6, "a"), (7, "c"))).collect()}
    assert found == {6: 1, 7: None}
    packed = index.filters().collect()
    assert sum(r.digests for r in packed) == 2 and all(len(r.table) == 2 * r.slots for r in packed)


def test_filter_overflows_resizes_and_forgets():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    small = X.CuckooFilter(10)
    for start in range(0, 5000, 500):
        small.insert(keys[start : start + 500], lambda start=start: keys[: start + 500])
    assert small.capacity >= 5000 and small.contains(keys).all()
    others = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    assert small.contains(others).mean() < 0.002
    assert all(small.delete(k) for k in keys[:2500])
    assert small.contains(keys[2500:]).all() and small.contains(keys[:2500]).mean() < 0.01


def test_false_positives_of_the_filter_are_verified(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(X.CuckooFilter, "contains", lambda self, keys: np.ones(len(keys), bool))
    bucket = X.DigestBucket(4)
    rows = [[hashlib.sha256(bytes([i % 3])).digest() for i in range(9)], [1] * 9, [1] * 9, list(range(9)), list(range(9))]
    bucket.add(pa.table([pa.array(c, t.type) for c, t in zip(rows, X.ENTRY_SCHEMA)], schema=X.ENTRY_SCHEMA))
    bucket.add(pa.table([pa.array(c, t.type) for c, t in zip(rows, X.ENTRY_SCHEMA)], schema=X.ENTRY_SCHEMA))
    assert bucket.entries().column("live").to_pylist() == [6, 6, 6]
