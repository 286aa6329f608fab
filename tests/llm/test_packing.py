import itertools
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from millrace.llm import packing, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*queries.byte_vocabulary())


def own_ids(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def library_ids(encoder, text):
    return encoder.exact.encode(text, add_special_tokens=False).ids


def check(rows, texts, encoder, capacity=1024):
    """Pieces join to the ids of each document, sequences have no gaps and no overlap; gives their number."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, pieces in by_doc.items():
        ids = np.array([*library_ids(encoder, texts[doc] or ""), 2], "<u4")
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == capacity for r in pieces[1:]) and 1 <= pieces[0].length <= capacity
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        assert sum(r.length for r in pieces) <= capacity
    return len(by_sequence)


def test_query_packs_every_id_into_nearly_the_fewest_sequences(spark, encoder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_packing(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    sequences = check(rows, texts, encoder)
    assert sequences <= -(-sum(r.length for r in rows) // 1024) * 1.005 + 1


def test_every_character_class_is_the_librarys(encoder):
    kinds = packing.character_classes()
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and kinds[i] != packing.UNKNOWN])
    # a character joins the run in front of it if it is of the same class
    for kind, front in ((packing.LETTER, "a"), (packing.NUMBER, "1"), (packing.OTHER, "!")):
        for part in np.array_split(points, 60):
            pieces = encoder.exact.pre_tokenizer.pre_tokenize_str("".join("\n" + front + chr(c) for c in part.tolist()))
            starts = {span[0] for _, span in pieces}
            joined = [3 * i + 2 not in starts for i in range(len(part))]
            assert joined == (kinds[part] == kind).tolist()


ALPHABET = "aA bsStrevmld'  \n\t1²½٣_-é漢　\xa0\x1c\x85ǅʰ́!?😀՘\U00032000Ⅷ"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20)), max_size=8))
def test_ids_are_the_librarys(encoder, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert own_ids(encoder, texts) == [library_ids(encoder, t) for t in texts]


def test_contractions_special_and_long_texts(encoder, monkeypatch):
    texts = ["I'll don't 'tis we've 'reason ''s  's x'S y'", "<|endoftext|>", "a<|endoftext|> b's<|endoftext|>", "", "\n\n", " ", "'", "'s"]
    assert own_ids(encoder, texts) == [library_ids(encoder, t) for t in texts]
    monkeypatch.setattr(packing, "CHUNK", 11)
    texts = ["can't  we   split \t here 'll" * 20, "x" * 200, " " * 90 + "y", "a " * 40 + "  ", "ab  cd\xa0 ef" * 9]
    assert own_ids(encoder, texts) == [library_ids(encoder, t) for t in texts]


def fewest(counts, capacity):
    """Fewest bins by exhaustive search."""
    items = sorted((n for n, m in enumerate(counts) for _ in range(m)), reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_use_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(3)
    for trial in range(60):
        capacity = int(rng.integers(4, 16))
        counts = np.zeros(capacity + 1, np.int64)
        for length in rng.integers(1, capacity + 1, int(rng.integers(0, 9))):
            counts[length] += 1
        plan = packing.plan_packing(counts, capacity)
        filled, number = Counter(), 0
        spots = defaultdict(list)
        for length in range(1, capacity + 1):
            for _ in range(counts[length]):
                run = np.searchsorted(plan.first, number, side="right") - 1
                inside = number - plan.first[run]
                sequence = int(plan.sequence[run] + inside // plan.each[run])
                spots[sequence].append((int(plan.offset[run] + inside % plan.each[run] * length), length))
                filled[sequence] += length
                number += 1
        assert sorted(filled) == list(range(plan.sequences)) and all(n <= capacity for n in filled.values())
        for pieces in spots.values():
            pieces.sort()
            assert [a for a, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1]
        assert plan.sequences <= fewest(counts, capacity) + 1


def test_patterns_fit_a_histogram_made_of_them():
    counts = np.zeros(101, np.int64)
    for pattern, n in (((20, 30, 50), 4000), ((40, 60), 3000), ((33, 33, 34), 500)):
        for length in pattern:
            counts[length] += n
    patterns = packing.patterns_of(np.flatnonzero(counts), 100)
    repeats = packing.fit_repeats(patterns, counts)
    used = sum(np.bincount(patterns[:, k], repeats, 101) for k in range(3))
    assert (repeats >= 0).all() and np.abs(used - counts)[1:].max() < 40
    assert packing.plan_packing(counts, 100).sequences == 7500


def test_odd_tables(spark, encoder):
    names = queries.byte_vocabulary()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, *names).collect() == []
    long = "word " * 300_000
    texts = {1: None, 2: "", 3: long, 4: "x" * 40_000, 5: "a b c"}
    docs = spark.createDataFrame([Row(doc_id=i, text=t, piece="p", task=0, length="n", rank=1) for i, t in texts.items()])
    rows = packing.pack(docs.repartition(3), *names).collect()
    check(rows, texts, encoder)
    assert [(r.start, r.length) for r in rows if r.doc_id in (1, 2)] == [(0, 1)] * 2
    again = spark.createDataFrame([(7, "same"), (7, "same"), (None, "same")], "doc_id long, text string")
    rows = packing.pack(again, *names).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["7", "7", "None"] and sorted(r.offset for r in rows) == [0, 2, 4]


def test_unassigned_characters_are_left_to_the_library(encoder):
    new = next(chr(i) for i in range(0x1F000, 0x30000) if unicodedata.category(chr(i)) == "Cn")
    assert own_ids(encoder, ["a" + new + " b", "plain"]) == [library_ids(encoder, t) for t in ("a" + new + " b", "plain")]
