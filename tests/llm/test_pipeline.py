import re

import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_stages_over_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).collect()
        seen[name] = out
        if name != "bpe":
            docs = spark.createDataFrame(out, docs.schema).select(names)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and not r.toxic}
    kept = {r.doc_id for r in seen["quality"]}
    assert len(clean & kept) >= 0.97 * len(clean)
    assert len(kept - clean & labels.keys()) and len((labels.keys() - clean) & kept) < 0.5 * len(labels.keys() - clean)
    assert {r.doc_id for r in seen["line_dedup"]} == kept
    assert {r.doc_id for r in seen["near_dedup"]} <= kept and len(seen["near_dedup"]) < len(kept)
    rows = {(r.doc_id) for r in seen["mixing"]}
    assert rows <= {r.doc_id for r in seen["near_dedup"]} and len(seen["bpe"]) == len(seen["mixing"])


def test_run_equals_its_stages(spark):
    a = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    b = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(a) == sorted(b)


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "s"), (1, text, "s"), (2, text + " x", "s"), (3, "other words here", "s"), (3, "not the same", "s"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id string")
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted(
        [("1", text), ("3", "other words here"), ("3", "not the same"), ("None", "")]
    )


def test_stages_take_empty_tables_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, None, None, "a", "b")], "doc_id long, text string, source string, row string, _kept string")
    for docs_in in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_in, FOLDER)
            if name != "bpe":
                assert out.columns == docs_in.columns
            assert out.count() <= 1
    plan = corpus_pipeline.drop_recurring_lines(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_near_dedup_stage_judges_rows_of_one_id_by_their_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    unique = "the only copy of this text stands under an id used twice"
    docs = spark.createDataFrame([(1, text), (3, text + " x"), (3, unique)], "doc_id long, text string")
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, FOLDER)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, text), (3, unique)]
