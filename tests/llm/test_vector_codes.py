import hashlib
import math

import numpy as np
import pytest

from millrace.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, entries=256, rounds=4, parts=4):
    """Every part against every entry in whole numbers, in each round."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(1024 * int(x)) if abs(x) > 2**50 else math.floor(1024 * x) for x in v], g) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def assign():
        found = []
        for c in cut:
            found.append([min((sum((x - y) ** 2 for x, y in zip(c[k], e)), i) for i, e in enumerate(books[k])) for k in range(parts)])
        return found

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for i in range(len(books[k])):
                own = [c[k] for c, f in zip(cut, found) if f[k][1] == i]
                if own:
                    books[k][i] = tuple(sum(x) // len(own) for x in zip(*own))
    found = assign()
    text = ",".join(str(x) for book in books for e in book for x in e)
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, g), e in zip(kept, errors):
        by_label[g] = by_label.get(g, 0) + e
    return sorted(
        # what does not fit in 64 bits is given as the largest number that does
        (str(i), "".join(f"{n:02x}" for _, n in f), min(e, 2**63 - 1), min(by_label[g], 2**63 - 1), hashlib.sha256(text.encode()).hexdigest())
        for (i, _, g), f, e in zip(kept, found, errors)
    )


def result(spark, rows, schema=SCHEMA, **options):
    found = vector_codes.coded(spark.createDataFrame(rows, schema).repartition(4), **options).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found)


@pytest.mark.parametrize("scale", [0.002, 1.0, 30_000.0, 1.5e6])
def test_against_brute_force(spark, scale):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.standard_normal((300, 8)) * 3) * scale / 3  # many ties
    rows = [(int(i), v.tolist(), None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(vectors)]
    rng.shuffle(rows)
    assert result(spark, rows, entries=20) == brute_force(rows, 20)


def test_rows_left_out_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i % 7 / 8, -i / 16, 1e-9, float(i)], i % 2) for i in range(40)]
    bad = [(50, None, 1), (51, [1.0, None, 2.0, 3.0], 1), (52, [nan, 0.0, 0.0, 0.0], 1), (53, [inf, 0.0, 0.0, -inf], None)]
    odd = [(3, good[3][1], 1), (None, [0.5, 0.5, 0.5, 0.5], None), (60, [0.0] * 4, None), (60, [0.0] * 4, None)]
    rows = [*good, *bad, *odd]
    assert result(spark, rows) == brute_force(rows)
    assert result(spark, rows, entries=3, rounds=9) == brute_force(rows, 3, 9)
    shorter = [(70, [1.0], 0), (71, [], 0)]
    assert result(spark, [*rows, *shorter], entries=3) == brute_force(rows, 3)


def test_no_rows_and_clashing_columns(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, 1)]) == []
    schema = "vec_id long, embedding array<float>, label string, vector int, entry string, distance int, code int, _label int"
    rows = [(i, [0.5 * i] * 4, "x", 0, "e", 1, 2, 3) for i in range(5)]
    want = brute_force([(i, v, g) for i, v, g, *_ in rows])
    assert result(spark, rows, schema) == want


def test_unmoved_entries_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (500, 4))
    book = rows[:16].copy()
    entry, distance = vector_codes.reassign(rows, book, np.ones(16, bool), np.full(500, -1), np.zeros(500, np.int64))
    new = book.copy()
    new[3] += 5
    seen = []
    nearest = vector_codes._nearest
    monkeypatch.setattr(vector_codes, "_nearest", lambda r, e: seen.append((len(r), len(e))) or nearest(r, e))
    moved = (new != book).any(1)
    got = vector_codes.reassign(rows, new, moved, entry, distance)
    want = vector_codes._nearest(rows, new)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    asleep = int((entry != 3).sum())
    assert seen[:2] == [(500 - asleep, 16), (asleep, 1)]


def test_distances_beyond_64_bits_stay_exact_in_comparison(spark):
    rows = [(0, [0.0] * 4, 1), (1, [1e15] * 4, 1), (2, [1e15 + 4] * 4, 2), (3, [-1e15] * 4, 2)]
    found = {r[0]: r[1:4] for r in result(spark, rows, entries=2, rounds=0)}
    assert found["2"][:2] == ("01010101", 4 * 4096**2)
    assert found["3"][:2] == ("00000000", (1 << 63) - 1) and found["3"][2] == (1 << 63) - 1
