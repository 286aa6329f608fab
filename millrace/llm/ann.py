"""Nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

A Gaussian projection to ``m`` dimensions turns a distance d into d times the root of a chi-square
variable with m degrees of freedom. So if the k-th neighbour found lies at distance d, an unseen
point that is nearer has, with probability p, a projected distance of at most d * sqrt(quantile(p)):
points are taken in the order of their projected distance and verified on the original vectors until
that radius is passed.

The upper levels of the kd-tree, fitted on a bounded sample of projections, cut the space into cells;
every vector is indexed in its cell. A query first searches its own cell. The distance it finds
there fixes the radius, and the query is sent on to the cells whose box the radius reaches.
Inside a cell the lower levels of the tree give the increasing order. Equal vectors are collapsed to
one point with the few smallest ids that can be asked for, so a vector that many rows share fills
no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store

#: Dimensions of the projection; even, so that the chi-square distribution has a closed form.
DIMENSIONS = 8
#: Probability that a nearer point lies inside the radius at which a search stops.
CONFIDENCE = 0.99
#: Vectors that fit the upper tree; the index itself holds all of them.
SAMPLE = 20_000
POINTS_PER_CELL = 4096
QUERIES_PER_TASK = 4096
LEAF = 64

POINT = "cell int, vector array<double>, ids array<long>"
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square with m degrees of freedom <= x) = p, for even m, by bisection."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        low, high = (low, (low + high) / 2) if below((low + high) / 2) >= p else ((low + high) / 2, high)
    return high


@dataclass(frozen=True)
class UpperTree:
    """A complete kd-tree: node i splits into 2 i + 1 and 2 i + 2; its leaves are the cells."""

    matrix: np.ndarray
    axis: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, matrix: np.ndarray) -> UpperTree:
        m = matrix.shape[1]
        axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        groups = [sample @ matrix]
        boxes = [(np.full(m, -np.inf), np.full(m, np.inf))]
        for level in range(depth):
            next_groups, next_boxes = [], []
            for k, (points, (low, high)) in enumerate(zip(groups, boxes)):
                node = (1 << level) - 1 + k
                if len(points):
                    axis[node] = np.ptp(points, axis=0).argmax()
                    value[node] = np.median(points[:, axis[node]])
                left = points[:, axis[node]] <= value[node]
                next_groups += [points[left], points[~left]]
                upper, lower = high.copy(), low.copy()
                upper[axis[node]] = min(upper[axis[node]], value[node])
                lower[axis[node]] = max(lower[axis[node]], value[node])
                next_boxes += [(low, upper), (lower, high)]
            groups, boxes = next_groups, next_boxes
        low, high = (np.array([b[side] for b in boxes]) for side in (0, 1))
        return cls(matrix, axis, value, low, high)

    @property
    def cells(self) -> int:
        return len(self.low)

    def cell_of(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), np.int64)
        while len(node) and node[0] < len(self.axis):  # all leaves have the same depth
            right = projected[np.arange(len(node)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)

    def reached(self, projected: np.ndarray, radius: float) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.low - projected, projected - self.high))
        return np.flatnonzero((gap**2).sum(1) <= radius**2)


class LowerTree:
    """The points of one cell in leaves of a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], matrix: np.ndarray):
        self.vectors, self.ids, self.matrix = vectors, ids, matrix
        self.projected = vectors @ matrix
        self.leaves: list[np.ndarray] = []
        pending = [np.arange(len(vectors))]
        while pending:
            rows = pending.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            axis = np.ptp(self.projected[rows], axis=0).argmax()
            order = rows[np.argsort(self.projected[rows, axis], kind="stable")]
            pending += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([self.projected[r].min(0) for r in self.leaves])
        self.high = np.array([self.projected[r].max(0) for r in self.leaves])

    def nearest(self, own: int, query: np.ndarray, k: int, bound: float, factor: float) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest, in leaves of growing projected distance until the test holds.

        ``bound`` is a distance within which k points are known already.
        """
        at = query @ self.matrix
        gap = np.maximum(0, np.maximum(self.low - at, at - self.high))
        nearness = np.sqrt((gap**2).sum(1))
        order = np.argsort(nearness, kind="stable")
        best: list[tuple[float, int]] = []
        start, step = 0, 1
        while start < len(order) and nearness[order[start]] <= bound * factor:
            rows = np.concatenate([self.leaves[i] for i in order[start : start + step]])
            start, step = start + step, step * 2
            near = ((self.projected[rows] - at) ** 2).sum(1) <= (bound * factor) ** 2
            rows = rows[near]
            distance = np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))
            for i in np.argsort(distance, kind="stable")[: k + 1]:
                if distance[i] > bound:
                    break
                best += [(float(distance[i]), v) for v in self.ids[rows[i]] if v != own]
            # equal distances beyond the first k + 1 points may hold a smaller id
            if len(rows) > k + 1:
                last = np.partition(distance, k)[k]
                best += [(float(last), v) for i in np.flatnonzero(distance == last) for v in self.ids[rows[i]] if v != own]
            best = sorted(set(best))[:k]
            if len(best) == k:
                bound = min(bound, best[-1][0])
        return best


def _usable(vector: Column) -> Column:
    """Whether a vector is there, is not zero and has finite numbers only."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def index_points(vectors: DataFrame, k: int, id_column: str, vector_column: str) -> DataFrame:
    """key, vector, ids: each distinct usable vector with its k + 1 smallest ids."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    keyed = rows.withColumn("key", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",")))
    first = Window.partitionBy("key").orderBy("vec_id")
    return (
        keyed.withColumn("rank", F.dense_rank().over(first))
        .filter(F.col("rank") <= k + 1)
        .groupBy("key")
        .agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )


def _search(routed: DataFrame, cells: DataFrame, parts: int, matrix: np.ndarray, k: int, factor: float) -> DataFrame:
    """Run every routed query (cell, query_id, vector, bound) over the points of its cell."""

    def search(queries: pa.Table, points: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(points):
            shape = len(matrix)
            tree = LowerTree(
                _matrix(points.column("vector").combine_chunks(), shape), points.column("ids").to_pylist(), matrix
            )
            asked = _matrix(queries.column("vector").combine_chunks(), shape)
            for name, vector, bound in zip(queries.column("query_id").to_pylist(), asked, queries.column("bound").to_pylist()):
                out += [(name, i, d) for d, i in tree.nearest(name, vector, k, bound, factor)]
        ids, found, scores = zip(*out) if out else ((), (), ())
        return pa.table({
            "query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64()),
        })

    # many queries of one cell are dealt over several tasks, each with the points of the cell
    asked = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    dealt = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn(
        "part", F.col("part").cast("long")
    )
    return asked.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(search, FOUND)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    confidence: float = CONFIDENCE,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest other rows of each query row.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id. Vectors that
    are null, zero, or hold null or non-finite numbers take no part, nor do rows without id or of
    another length than most. Rows repeating an id and a vector count once. With k other
    vectors or fewer all are given; an empty table gives no rows.
    """
    points = store(index_points(vectors, k, id_column, vector_column), "points")
    shapes = points.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    shape = shapes.orderBy(F.desc("n"), F.desc("d")).first()
    dimension, n = (shape["d"], shape["n"]) if shape else (1, 0)
    points = points.filter(F.size("vector") == dimension)
    sample = points.orderBy("key").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    matrix = np.random.default_rng(seed).standard_normal((dimension, DIMENSIONS))
    depth = max(0, math.ceil(math.log2(max(n, 1) / POINTS_PER_CELL)))
    tree = UpperTree.fit(_matrix(sample, dimension), depth, matrix)
    factor = math.sqrt(chi_square_quantile(confidence, DIMENSIONS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.cell_of(_matrix(batch.column("vector"), dimension) @ matrix)
            columns = [pa.array(cell, pa.int32()), batch.column("vector"), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "vector", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projected = _matrix(batch.column("vector"), dimension) @ matrix
            home = tree.cell_of(projected)
            bounds = batch.column("bound").to_pylist()
            hits = [c[c != h] for c, h in ((tree.reached(p, b * factor), h) for p, b, h in zip(projected, bounds, home))]
            row = pa.array(np.repeat(np.arange(len(hits)), [len(c) for c in hits]))
            cell = pa.array(np.concatenate([*hits, np.empty(0, np.int64)]).astype(np.int32))
            columns = [cell, *(batch.column(c).take(row) for c in ("query_id", "vector", "bound"))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "query_id", "vector", "bound"])

    cells = store(points.select("vector", "ids").mapInArrow(place, POINT), "cells")
    asked = vectors.filter(is_query).select(
        F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    asked = store(
        asked.filter(F.col("query_id").isNotNull() & _usable(F.col("vector")) & (F.size("vector") == dimension))
        .distinct()
        .select("vector", F.array("query_id").alias("ids"))
        .mapInArrow(place, POINT)
        .select("cell", F.get("ids", 0).alias("query_id"), "vector"),
        "queries",
    )

    def parts(routed: DataFrame) -> int:
        return max(1, math.ceil(routed.count() / tree.cells / QUERIES_PER_TASK))

    first = asked.withColumn("bound", F.lit(float("inf")))
    at_home = store(_search(first, cells, parts(first), matrix, k, factor), "home")
    # within the k-th distance there are k points already; with fewer every cell is searched
    bounds = at_home.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound")
    )
    routed = store(
        asked.join(bounds, "query_id", "left")
        .select("query_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        .mapInArrow(route, "cell int, query_id long, vector array<double>, bound double"),
        "routed",
    )
    found = at_home.union(_search(routed, cells, parts(routed), matrix, k, factor)).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
