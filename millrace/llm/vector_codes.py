"""Vector codes by Lloyd's algorithm that compares only with the entries that moved.

Vectors are whole numbers (components times 1024, rounded down) cut into parts; each part position has
a codebook of its own. Every row stores, for each part, its entry and the exact squared distance to it. In the
next round a part whose entry stayed where it was compares only the entries that moved with the stored
distance: all other entries are as far away as before. A part whose entry moved compares all entries again.
Equal distances go to the lower index in both cases, so every round gives what a full scan would.

Codebooks are all that comes to the driver: sums and counts per entry, combined in each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, store

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
MOST = (1 << 63) - 1
#: Rows compared with a codebook at once.
ROWS_AT_ONCE = 2000
#: Labels whose errors are broadcast; with more the planner chooses the join.
MAX_BROADCAST_LABELS = 1_000_000


def part_bounds(dimension: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; a remainder goes to the later ones."""
    return [k * dimension // parts for k in range(parts + 1)]


def _number_type(width: int, largest: int) -> type:
    """The fastest type in which sums of ``width`` squared differences are exact."""
    bound = 4 * max(width, 1) * largest * largest
    return np.float64 if bound < 1 << 53 else np.int64 if bound < MOST else object


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def _nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, the lower index of equal ones."""
    distance = (rows * rows).sum(1)[:, None] - 2 * (rows @ entries.T) + (entries * entries).sum(1)[None, :]
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(rows)), best]


def reassign(
    rows: np.ndarray, codebook: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """New entry and distance of each row; an entry below 0 is none yet.

    A distance that does not fit in 64 bits is stored as the largest number that does, and then
    compared with all entries again.
    """
    kind = _number_type(rows.shape[1], max(_largest(rows), _largest(codebook)))
    rows, codebook = rows.astype(kind), codebook.astype(kind)
    active = (entry >= 0) & (distance < MOST)
    active[active] = ~moved[entry[active]]
    entry, distance = entry.copy(), distance.copy()

    def fitting(found: np.ndarray) -> np.ndarray:
        return np.array([min(int(d), MOST) for d in found], np.int64) if kind is object else found.astype(np.int64)

    full = np.flatnonzero(~active)
    for at in (full[i : i + ROWS_AT_ONCE] for i in range(0, len(full), ROWS_AT_ONCE)):
        best, found = _nearest(rows[at], codebook)
        entry[at], distance[at] = best, fitting(found)
    changed, some = np.flatnonzero(moved), np.flatnonzero(active)
    if len(changed):
        for at in (some[i : i + ROWS_AT_ONCE] for i in range(0, len(some), ROWS_AT_ONCE)):
            best, found = _nearest(rows[at], codebook[changed])
            best, found = changed[best], fitting(found)
            nearer = (found < distance[at]) | ((found == distance[at]) & (best < entry[at]))
            entry[at[nearer]], distance[at[nearer]] = best[nearer], found[nearer]
    return entry, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1), kind), values.shape[1]).cast(pa.list_(kind))


def _assign(bounds: list[int], codebooks: list[np.ndarray], moved: list[np.ndarray]):
    parts = len(codebooks)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), bounds[-1])
            entry, distance = _matrix(batch.column("entry"), parts).copy(), _matrix(batch.column("distance"), parts).copy()
            for k in range(parts):
                own = rows[:, bounds[k] : bounds[k + 1]]
                entry[:, k], distance[:, k] = reassign(own, codebooks[k], moved[k], entry[:, k], distance[:, k])
            new = {"entry": _lists(entry, pa.int32()), "distance": _lists(distance, pa.int64())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return assign


def _partial_sums(bounds: list[int], entries: int):
    """Per task: part, entry, place in the part, sum and count of the rows with that entry."""
    parts = len(bounds) - 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((entries, bounds[k + 1] - bounds[k]), object) for k in range(parts)]
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            rows, entry = _matrix(batch.column("vector"), bounds[-1]), _matrix(batch.column("entry"), parts)
            if not len(rows):
                continue
            # a batch has few rows: its sums fit in 64 bits unless numbers are very large
            kind = np.int64 if _largest(rows) * len(rows) < MOST else object
            for k in range(parts):
                order = np.argsort(entry[:, k], kind="stable")
                used, first = np.unique(entry[order, k], return_index=True)
                sums = np.add.reduceat(rows[order, bounds[k] : bounds[k + 1]].astype(kind), first, axis=0)
                totals[k][used] += sums.astype(object)
                counts[k] += np.bincount(entry[:, k], minlength=entries)
        for k in range(parts):
            used, width = np.flatnonzero(counts[k]), bounds[k + 1] - bounds[k]
            if not len(used) or not width:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * width, k), pa.int32()),
                    pa.array(np.repeat(used, width), pa.int32()),
                    pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                    pa.array([int(x) for x in totals[k][used].reshape(-1)], pa.decimal128(38, 0)),
                    pa.array(np.repeat(counts[k][used], width)),
                ],
                names=["part", "entry", "place", "total", "n"],
            )

    return add


def _moved(state: DataFrame, bounds: list[int], codebooks: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The codebooks with each used entry at the mean of its parts, rounded down, and which entries moved."""
    sums = state.mapInArrow(
        _partial_sums(bounds, len(codebooks[0])), "part int, entry int, place int, total decimal(38,0), n long"
    )
    # one number per codebook component
    found = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    new = [c.copy() for c in codebooks]
    for r in found:
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new, [(a != b).any(1) for a, b in zip(codebooks, new)]


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, label, vector of the rows whose vector is there and holds finite numbers only."""
    value = F.col(vector_column).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.coalesce(finite, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label_column).alias("label"),
        F.transform(value, lambda x: F.floor(x * F.lit(float(SCALE)))).alias("vector"),
    )


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, entry, distance of every usable row, both one number per part; the codebooks).

    A row is usable if its vector is not null and holds finite numbers only, and is as long as most of
    these are (of equally frequent lengths, the greatest). Null and repeated ids and repeated rows are rows like others.
    A codebook begins with the parts of the first rows by id, then vector, null ids last, and is
    shorter where there are fewer rows. Components are exact up to 2^63 / 1024 and count as that beyond; a distance that does not fit in 64 bits is
    given as the largest number that does. Without usable rows there are no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry number has two hexadecimal digits: at most 256 entries")
    usable = store(whole_numbers(vectors, id_column, vector_column, label_column), "whole")
    shapes = usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    shape = shapes.orderBy(F.desc("n"), F.desc("d")).first()
    dimension = shape["d"] if shape else 0
    bounds = part_bounds(dimension, parts)
    rows = usable.filter(F.size("vector") == dimension)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    first = _matrix(start.column("vector").combine_chunks(), dimension) if len(start) else np.zeros((0, dimension), np.int64)
    codebooks = [first[:, a:b].astype(np.int64) for a, b in zip(bounds, bounds[1:])]
    state = rows.withColumns(
        {
            "entry": F.array_repeat(F.lit(-1), parts),
            "distance": F.array_repeat(F.lit(MOST), parts),
        }
    )
    moved = [np.ones(len(c), bool) for c in codebooks]
    held = usable
    for turn in range(rounds + 1):
        if not any(m.any() for m in moved):
            break  # nothing would change
        state = store(state.mapInArrow(_assign(bounds, codebooks, moved), state.schema), "assigned")
        discard(held)
        held = state
        if turn < rounds:
            codebooks, moved = _moved(state, bounds, codebooks)
    return state.drop("vector"), codebooks


def coded(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row; see ``compress``.

    ``label_error`` sums the errors of all rows with an equal label, null labels together.
    """
    state, codebooks = compress(vectors, **options)
    text = ",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist())

    def fitting(total: Column) -> Column:
        return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")

    total = F.aggregate("distance", F.lit(0).cast("decimal(38,0)"), lambda t, d: (t + d).cast("decimal(38,0)"))
    digits = F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    rows = state.select("vec_id", "label", F.array_join(digits, "").alias("code"), fitting(total).alias("error"))
    sums = rows.groupBy("label").agg(fitting(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    sums = store(sums.withColumnRenamed("label", "_label"), "label_errors")
    if sums.count() <= MAX_BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.sha2(F.lit(text), 256).alias("codebooks_sha256")
    )
