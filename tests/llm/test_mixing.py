import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import mixing


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson_count(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_order_and_shares_against_plain_poisson(spark):
    docs = spark.range(0, 4000, 1, 5).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w"), (F.col("id") % 9).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.lit("mine").alias("_copy"),
    )
    weights = {"hot": 1, "s1": 3, "s2": 0.5, "gone": 2}
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights).collect()}
    got = mixing.mix(docs, weights, seed=5).collect()
    want = Counter()
    for r in docs.collect():
        rate = rates[r.source]
        for c in range(poisson_count(rate, unit(f"copies-5:{r.doc_id}")) if rate else 0):
            want[r.doc_id, r.source, c, unit(f"order-5:{r.doc_id}:{c}")] += 1
    assert Counter((r.doc_id, r.source, r._copy, r._spot) for r in got) == want
    assert [r._spot for r in got] == sorted(r._spot for r in got)
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
    total = sum(size.values())
    for source, w in weights.items():
        if source != "gone":
            assert abs(size[source] / total - w / 4.5) < 0.06
    assert "s0" not in size


def test_large_rates_and_odd_rows(spark):
    rows = [(1, "a", "tiny"), (None, "b", None), (2, None, "blank"), (3, "", "blank"), (1, "a", "tiny")]
    rows += [(100 + i, "x" * 50, "big") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.source) for r in mixing.mix(docs, {"tiny": 1, "big": 1}).collect())
    # two rows of one character share half of 5003 characters
    assert abs(got[1, "tiny"] - 2502) < 400 and got[1, "tiny"] % 2 == 0
    assert got[2, "blank"] == got[None, None] == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "_copy", "_spot"]
