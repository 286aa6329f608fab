import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ann, queries

FOLDER = "/root/testdata/sf0.1"


def brute_force(rows, asked, k=10):
    """rows: (id, vector) of usable vectors; the k nearest of each asked id."""
    out = {}
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    for i, v in rows:
        if i in asked:
            distance = np.sqrt(((matrix - np.array(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, distance)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(distance[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = brute_force(rows, {i for i, _ in rows if i % 100 == 0})
    got = answers(queries.op9_nearest(spark, FOLDER))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    for q in want:
        exact = dict(brute_force(rows, {q}, len(rows))[q])
        assert all(abs(exact[i] - d) < 1e-12 for i, d in got[q])


def test_several_cells_clusters_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "POINTS_PER_CELL", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 5
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16)]) for i in range(800)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.nearest(docs, F.col("vec_id") % 50 == 0))
    want = brute_force(rows, {i for i, _ in rows if i % 50 == 0})
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert got[1000] == [(0, 0.0), *((1001 + i, 0.0) for i in range(9))]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.0, 0.0], None), (3, None, "b"), (4, [1.0, None], "b"),
        (5, [nan, 1.0], "b"), (6, [inf, 1.0], "b"), (7, [], "b"), (8, [1.0, 0.0], "b"), (None, [1.0, 0.0], "b"),
        (9, [1.0, 2.0, 3.0], "b"), (0, [1.0, 0.0], "a"),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    assert answers(ann.nearest(docs, F.lit(True))) == {
        0: [(8, 0.0), (1, math.sqrt(2))], 1: [(0, math.sqrt(2)), (8, math.sqrt(2))], 8: [(0, 0.0), (1, math.sqrt(2))],
    }
    assert ann.nearest(docs.limit(0), F.lit(True)).count() == 0


def test_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
    assert abs(ann.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
