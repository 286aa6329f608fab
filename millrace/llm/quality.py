"""Quality classification by co-training of a text view and a metadata view.

Two classifiers see different sides of a document: one its words (whole, their first and last
letters, and the shape of the text), the other its metadata (source, language, size). Both are
logistic regressions over indicator features that are significantly more or less frequent in bad
documents. In each round every view labels the unlabelled documents it is confident about, and the
other view trains on them too. At the end both are calibrated on labelled documents that neither
was trained on, and a logistic combination of the calibrated views scores all documents.

Only the fit uses samples, and its bounds are parameters: ``labelled`` rows of the label table and
``pool`` rows without a label, both the first by a hash of their ids. Every document is scored by
its whole text, in one pass that moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, string_column, text_of, text_slices, utf8_buffer

LABELLED, POOL = 12_000, 4_000
ROUNDS = 3
#: Probability at which a view's label is taken over by the other view.
CONFIDENT = 0.97
#: A feature is used if that many documents have it and its share of bad ones is that unusual.
MIN_DOCUMENTS, MIN_DEVIATIONS, MAX_FEATURES = 5, 5.0, 2000
#: Text features that reach the fit at all.
CANDIDATES = 5_000
RIDGE = 1e-4
STRINGS, NUMBERS = ("source", "lang"), ("n_chars",)


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode()) >> 1  # fits a signed number


def word_features(word: str) -> tuple[str, ...]:
    """What a word says: itself, how it begins and how it ends."""
    return f"w:{word}", f"p4:{word[:4]}", f"p6:{word[:6]}", f"s:{word[-3:]}"


def shape_features(text_bytes: np.ndarray, n: int, kinds: int, top: int) -> list[str]:
    """Steps of how large, repetitive, shouted and symbol-ridden a text is."""
    size = max(len(text_bytes), 1)
    upper = int(((text_bytes >= 65) & (text_bytes <= 90)).sum())
    lower = int(((text_bytes >= 97) & (text_bytes <= 122)).sum())
    digits = int(((text_bytes >= 48) & (text_bytes <= 57)).sum())
    plain = upper + lower + digits + int(((text_bytes >= 128) | (text_bytes <= 32)).sum())
    length = int(np.log2(n + 1))
    return [
        f"repeats:{length}:{int(10 * kinds / max(n, 1))}",
        f"top:{min(int(20 * top / max(n, 1)), 10) if n > 8 else 'few'}",
        f"upper:{int(10 * upper / max(upper + lower, 1))}",
        f"symbols:{min(int(40 * (size - plain) / size), 20)}",
        f"digits:{min(int(40 * digits / size), 20)}",
        f"word:{min(int(size / max(n, 1)), 30)}",
        f"blank:{n == 0}",
    ]


def text_features(texts: pa.Array, known: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text end to end, and the n + 1 bounds.

    Features are hashes, or, with ``known``, the numbers of those that it holds.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), lengths)
    filled = np.array([w != "" for w in distinct], bool)
    keep = filled[codes] if len(codes) else np.empty(0, bool)
    codes, owner = codes[keep], owner[keep]
    pairs, times = np.unique(owner * np.int64(max(len(distinct), 1)) + codes, return_counts=True)
    word, document = pairs % max(len(distinct), 1), pairs // max(len(distinct), 1)

    named: dict[str, int] = {}

    def number(feature: str) -> int:
        found = named.get(feature)
        if found is None:
            found = _hash(feature)
            named[feature] = found = found if known is None else known.get(found, -1)
        return found

    table = np.array([[number(f) for f in word_features(w)] for w in distinct], np.int64).reshape(-1, 4)
    columns, owners = [table[word].ravel()], [np.repeat(document, 4)]
    n = np.bincount(owner, minlength=len(texts))
    kinds = np.bincount(document, minlength=len(texts))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, document, times)
    raw, bounds = utf8_buffer(texts)
    for i in range(len(texts)):
        shape = [number(f) for f in shape_features(raw[bounds[i] : bounds[i + 1]], int(n[i]), int(kinds[i]), int(top[i]))]
        columns.append(np.array(shape, np.int64))
        owners.append(np.full(len(shape), i))
    value, owner = np.concatenate(columns), np.concatenate(owners)
    value, owner = value[value >= 0], owner[value >= 0]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def metadata_features(batch: pa.RecordBatch, strings: Sequence[str], numbers: Sequence[str]) -> list[list[int]]:
    """Hashes of each row's metadata values; numbers count by their power of two, nulls are a value."""
    columns = [[f"{c}={v}" for v in batch.column(f"_{c}").to_pylist()] for c in strings]
    for c in numbers:
        values = batch.column(f"_{c}").to_pylist()
        columns.append([f"{c}~{None if v is None else int(np.log2(abs(v) + 1))}" for v in values])
    return [[_hash(f) for f in row] for row in zip(*columns)] if columns else [[] for _ in range(batch.num_rows)]


@dataclass
class Sparse:
    """Rows of indicator features: ``names`` ascending, and in each row the numbers of its features, four bytes each.

    Without names, ``value`` holds the features themselves.
    """

    value: np.ndarray
    bounds: np.ndarray
    names: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.names is None:
            self.names, self.value = np.unique(self.value, return_inverse=True)
        self.value = self.value.astype(np.int32, copy=False)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.bounds))

    def take(self, rows: np.ndarray) -> Sparse:
        parts = [self.value[self.bounds[i] : self.bounds[i + 1]] for i in rows]
        lengths = [len(p) for p in parts]
        return Sparse(np.concatenate([*parts, np.empty(0, np.int32)]), np.cumsum([0, *lengths]), self.names)


@dataclass
class View:
    """One logistic regression: the weight of each feature, and a bias."""

    weights: dict[int, float]
    bias: float

    @classmethod
    def fit(cls, rows: Sparse, bad: np.ndarray) -> View:
        share = min(max(bad.mean(), 1e-6), 1 - 1e-6) if len(bad) else 0.5
        names, number, owner = rows.names, rows.value, rows.row
        n = np.bincount(number, minlength=len(names))
        n_bad = np.bincount(number, bad[owner], minlength=len(names))
        deviation = np.abs(n_bad - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
        chosen = np.flatnonzero((n >= MIN_DOCUMENTS) & (deviation >= MIN_DEVIATIONS))
        chosen = chosen[np.argsort(-deviation[chosen], kind="stable")[:MAX_FEATURES]]
        place = np.full(len(names), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        used = place[number] >= 0
        column, row = place[number[used]], owner[used]
        weights, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
        # Nesterov's accelerated gradient with a step for each weight: its curvature is at most a quarter of the
        # number of features in the rows that have it
        width = np.bincount(row, minlength=len(bad)) + 1.0
        step = 4 * len(bad) / np.maximum(np.bincount(column, width[row], minlength=len(chosen)), 1)
        bias_step = 4 * len(bad) / width.sum()
        ahead, ahead_bias, momentum = weights.copy(), bias, 1.0
        for _ in range(200):
            margin = np.bincount(row, ahead[column], minlength=len(bad)) + ahead_bias
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - bad) / len(bad)
            new = ahead - step * (np.bincount(column, error[row], minlength=len(chosen)) + RIDGE * ahead)
            new_bias = ahead_bias - bias_step * error.sum()
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            pull = (momentum - 1) / following
            ahead, ahead_bias = new + pull * (new - weights), new_bias + pull * (new_bias - bias)
            weights, bias, momentum = new, new_bias, following
        return cls(dict(zip(names[chosen].tolist(), weights.tolist())), float(bias))

    def margin(self, rows: Sparse) -> np.ndarray:
        weight = np.array([self.weights.get(v, 0.0) for v in rows.names.tolist()])
        return np.bincount(rows.row, weight[rows.value] if len(weight) else None, minlength=len(rows)) + self.bias


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(columns: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on few columns, by Newton's method."""
    x = np.column_stack([columns, np.ones(len(bad))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _logistic(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - bad) + 1e-2 * w), -2, 2)
    return w


@dataclass
class CoTrained:
    """Both views, the calibration of each and their combination."""

    text: View
    metadata: View
    scales: tuple[np.ndarray, np.ndarray]
    blend: np.ndarray

    @classmethod
    def fit(cls, text: Sparse, metadata: Sparse, label: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
        """``label`` is 1 for bad, 0 for good, -1 for unlabelled rows."""
        labelled, pool = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
        held, trained = labelled[::5], np.setdiff1d(labelled, labelled[::5])
        views = [text, metadata]
        given = [(trained, label[trained].astype(float))] * 2
        fitted: list[View] = []
        for turn in range(rounds + 1):
            fitted = [View.fit(v.take(rows), bad) for v, (rows, bad) in zip(views, given)]
            if turn == rounds or not len(pool):
                break
            scales = [fit_linear(m.margin(v.take(held))[:, None], label[held]) for m, v in zip(fitted, views)]
            taught = []
            for model, view, scale in zip(fitted, views, scales):
                p = _logistic(model.margin(view.take(pool)) * scale[0] + scale[1])
                sure = np.maximum(p, 1 - p) >= CONFIDENT
                taught.append((pool[sure], (p[sure] > 0.5).astype(float)))
            given = [
                (np.concatenate([trained, rows]), np.concatenate([label[trained], bad])) for rows, bad in reversed(taught)
            ]
        margins = [m.margin(v.take(held)) for m, v in zip(fitted, views)]
        scales = tuple(fit_linear(m[:, None], label[held]) for m in margins)
        calibrated = np.column_stack([m * s[0] + s[1] for m, s in zip(margins, scales)])
        return cls(*fitted, scales, fit_linear(calibrated, label[held]))

    def bad(self, margins: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the views and of their combination that rows are bad."""
        calibrated = [m * s[0] + s[1] for m, s in zip(margins, self.scales)]
        both = np.column_stack(calibrated) @ self.blend[:-1] + self.blend[-1]
        return (*map(_logistic, calibrated), _logistic(both))


def _with_metadata(docs: DataFrame, text_column: str, strings: Sequence[str], numbers: Sequence[str]) -> list:
    have = set(docs.columns)
    return [
        text_of(text_column).alias("_text"),
        *(F.col(c).cast("string").alias(f"_{c}") if c in have else F.lit(None).cast("string").alias(f"_{c}") for c in strings),
        *(F.col(c).cast("double").alias(f"_{c}") if c in have else F.lit(None).cast("double").alias(f"_{c}") for c in numbers),
    ]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    labelled: int = LABELLED,
    pool: int = POOL,
    strings: Sequence[str] = STRINGS,
    numbers: Sequence[str] = NUMBERS,
) -> CoTrained | None:
    """Fit on at most ``labelled`` + ``pool`` documents; None if a class has fewer than ten labels.

    ``labels`` has doc_id, quality, toxic: bad is a quality of 0 or a toxic of 1; a null does not
    count, a document with several labels is bad if one says so.
    """
    verdict = F.greatest(F.lit(1) - F.col("quality"), F.col("toxic")).cast("int")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), verdict.alias("_bad"))
        .filter("_id is not null and _bad is not null")
        .groupBy("_id")
        .agg(F.max("_bad").alias("_bad"))
    )
    ids = docs.select(F.col(id_column).cast("long").alias("_id")).filter("_id is not null").distinct()
    order = F.xxhash64("_id")
    some = ids.join(known, "_id").orderBy(order).limit(labelled)
    others = ids.join(known, "_id", "left_anti").orderBy(order).limit(pool).withColumn("_bad", F.lit(-1))
    picked = store(some.union(others), "picked")

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), *_with_metadata(docs, text_column, strings, numbers))
    # the picked ids are bounded by the two parameters
    rows = rows.join(F.broadcast(picked), "_id")
    telling = _telling_features(rows.filter("_bad >= 0").select("_bad", "_text"), picked)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metadata = metadata_features(batch, strings, numbers)
            for start, texts in text_slices(string_column(batch, "_text")):
                value, bounds = text_features(texts, telling)
                columns = [batch.column(c).slice(start, len(texts)) for c in ("_id", "_bad")]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value, pa.int32()))
                columns += [lists, pa.array(metadata[start : start + len(texts)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_bad", "words", "metadata"])

    sample = (
        rows.select("_id", "_bad", *(c for c in rows.columns if c not in ("_id", "_bad")))
        .mapInArrow(features, "_id long, _bad int, words array<int>, metadata array<long>")
        .toArrow()
        .combine_chunks()
    )
    order = np.lexsort((sample.column("_bad").to_numpy(), sample.column("_id").to_numpy()))
    order = order[np.unique(sample.column("_id").to_numpy()[order], return_index=True)[1]]  # one row an id
    label = sample.column("_bad").to_numpy()[order]
    if min((label == 0).sum(), (label == 1).sum()) < 10:
        return None
    views = []
    for name, names in (("words", np.array(list(telling), np.int64)), ("metadata", None)):
        lists = sample.column(name).combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        full = Sparse(lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths))), names)
        views.append(full.take(order))
    del sample, lists
    return CoTrained.fit(*views, label)


def _telling_features(labelled: DataFrame, picked: DataFrame) -> dict[int, int]:
    """The ``CANDIDATES`` text features that depart most from the labels' share, ascending, each with its number."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = batch.column("_bad").to_numpy()
            for start, texts in text_slices(string_column(batch, "_text")):
                value, bounds = text_features(texts)
                names, number = np.unique(value, return_inverse=True)
                weight = np.repeat(bad[start : start + len(texts)], np.diff(bounds))
                counts = [np.bincount(number, w, minlength=len(names)).astype(np.int64) for w in (None, weight)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, (names, *counts))], names=["feature", "n", "n_bad"])

    share = picked.filter("_bad >= 0").agg(F.avg("_bad")).first()[0] or 0.0
    spread = max(share * (1 - share), 1e-9)
    deviation = F.abs(F.col("n_bad") - F.col("n") * share) / F.sqrt(F.col("n") * spread)
    chosen = (
        labelled.mapInArrow(tally, "feature long, n long, n_bad long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
        .filter(F.col("n") >= MIN_DOCUMENTS)
        .withColumn("deviation", deviation)
        .filter(F.col("deviation") >= MIN_DEVIATIONS / 2)
        .orderBy(F.desc("deviation"), "feature")
        .limit(CANDIDATES)
    )
    return {feature: i for i, feature in enumerate(sorted(r["feature"] for r in chosen.select("feature").collect()))}


def classify(
    docs: DataFrame,
    model: CoTrained | None,
    threshold: float = 0.5,
    text_column: str = "text",
    strings: Sequence[str] = STRINGS,
    numbers: Sequence[str] = NUMBERS,
) -> DataFrame:
    """The columns of ``docs`` and _p_text, _p_metadata, _p_bad, _kept.

    A document is kept if its probability of being bad is below ``threshold``. Null texts are empty,
    missing or null metadata are a value like others, repeated rows score alike, and an empty table
    gives no rows. Without a model every document has null scores and is kept. Columns of the four
    names in the input are replaced.
    """
    docs = docs.drop("_p_text", "_p_metadata", "_p_bad", "_kept")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", none.alias("_p_text"), none.alias("_p_metadata"), none.alias("_p_bad"), F.lit(True).alias("_kept"))
    own = docs.columns
    known = {name: i for i, name in enumerate(model.text.weights)}
    weights = np.array([*model.text.weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metadata = metadata_features(batch, strings, numbers)
            told = np.array([sum(model.metadata.weights.get(f, 0.0) for f in row) for row in metadata]) + model.metadata.bias
            for start, texts in text_slices(string_column(batch, "_text")):
                value, bounds = text_features(texts, known)
                row = np.repeat(np.arange(len(texts)), np.diff(bounds))
                said = np.bincount(row, weights[value], minlength=len(texts)) + model.text.bias
                scores = model.bad((said, told[start : start + len(texts)]))
                columns = [batch.column(f"own_{c}").slice(start, len(texts)) for c in own]
                columns += [*map(pa.array, scores), pa.array(scores[2] < threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "_p_text", "_p_metadata", "_p_bad", "_kept"])

    added = [T.StructField(n, T.DoubleType()) for n in ("_p_text", "_p_metadata", "_p_bad")]
    schema = T.StructType([*docs.schema.fields, *added, T.StructField("_kept", T.BooleanType())])
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"own_{c}") for c in own), *_with_metadata(docs, text_column, strings, numbers)
    )
    return rows.mapInArrow(run, schema)
