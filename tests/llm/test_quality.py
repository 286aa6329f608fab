import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")]


def test_labels_that_were_not_trained_on(spark, tables):
    docs, labels = tables
    # every fifth labelled document is unknown to the model
    unknown = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    model = quality.train(docs, labels.filter(~unknown))
    judged = quality.classify(docs, model).join(labels.filter(unknown), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    n = {(r.bad, r._kept): r["count"] for r in judged.groupBy(bad.alias("bad"), "_kept").count().collect()}
    assert n[False, True] >= 0.98 * (n[False, True] + n.get((False, False), 0))
    assert n[True, False] >= 0.9 * (n[True, False] + n.get((True, True), 0))
    calibrated = judged.agg(F.avg("_p_bad"), F.avg(bad.cast("double"))).first()
    assert abs(calibrated[0] - calibrated[1]) < 0.05


def test_query_scores_every_document_alike_on_any_partitioning(spark, tables):
    rows = {r.doc_id: r for r in queries.op8_quality(spark, FOLDER).collect()}
    docs, labels = tables
    assert len(rows) == docs.count()
    again = quality.classify(docs.repartition(7), quality.train(docs.repartition(5), labels))
    assert all(abs(rows[r.doc_id].p_bad - r._p_bad) < 1e-9 for r in again.collect())


def test_scores_equal_a_sum_over_features_written_out(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    some = docs.orderBy("doc_id").limit(60)
    for r in quality.classify(some, model).collect():
        words = [w for w in r.text.lower().split() if w]
        counts = {w: words.count(w) for w in set(words)}
        names = {f for w in counts for f in quality.word_features(w)}
        raw = np.frombuffer(r.text.encode(), np.uint8)
        names |= set(quality.shape_features(raw, len(words), len(counts), max(counts.values(), default=0)))
        text = model.text.bias + sum(model.text.weights.get(quality._hash(f), 0.0) for f in names)
        said = {f"source={r.source}", f"lang={r.lang}", f"n_chars~{int(np.log2(r.n_chars + 1))}"}
        metadata = model.metadata.bias + sum(model.metadata.weights.get(quality._hash(f), 0.0) for f in said)
        p = model.bad((np.array([text]), np.array([metadata])))
        assert [r._p_text, r._p_metadata, r._p_bad] == pytest.approx([float(x[0]) for x in p])


def test_confident_labels_cross_between_the_views():
    rng = np.random.default_rng(2)
    bad = rng.random(3000) < 0.3
    text = [[1] if b else [2] for b in bad]
    # the metadata view's feature 30 is seen only in unlabelled rows, and tells as much as the text
    metadata = [[30] if b and i >= 600 else [31] for i, b in enumerate(bad)]

    def sparse(rows):
        return quality.Sparse(np.concatenate(rows).astype(np.int64), np.cumsum([0, *map(len, rows)]))

    label = np.where(np.arange(3000) < 600, bad.astype(int), -1)
    alone = quality.CoTrained.fit(sparse(text), sparse(metadata), label, rounds=0)
    taught = quality.CoTrained.fit(sparse(text), sparse(metadata), label, rounds=2)
    assert 30 not in alone.metadata.weights and taught.metadata.weights[30] > 1


def test_odd_rows_and_too_few_labels(spark, tables):
    docs, labels = tables
    model = quality.train(docs, labels.union(spark.createDataFrame([(None, 1, 0), (3, None, None), (0, 1, None)], labels.schema)))
    rows = [(1, None, None, None, 1), (None, "", "src1", None, 2), (2, "x" * 300000, "src1", -5, 3), (2, "x" * 300000, "src1", -5, 3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _kept int")
    out = quality.classify(odd, model)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "_p_text", "_p_metadata", "_p_bad", "_kept"]
    assert [r.doc_id for r in out.collect()] == [1, None, 2, 2]
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.train(docs, labels.limit(3)) is None
    kept = quality.classify(odd, None).collect()
    assert all(r._kept and r._p_bad is None for r in kept)
