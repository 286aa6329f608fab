import hashlib

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_str(queries.vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = expected(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


ODD = [
    None, "", " \n\t ", "Hello  World's 123", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "ÉΣΑΣ Σ ΌΔΟΣ.",
    "é ́x nëe", "a b c　d\x1ce\x85f", "it's they'll I'D 'RE we've'd", "日本語 テスト 한국어", "😀👩‍👩‍👧 ½ ² ١٢٣",
    "\x00\x01\x7f ﻿​z", "Ǆ İstanbul ſ ẞ ß", "a" * 5000, "don''t ''s 's't", "--- ### $$$ a.b,c;d", "ﬁ Å Å Ω",
]


@pytest.mark.parametrize("words", [0, 50, 1 << 17])
def test_odd_texts_with_any_lexicon(spark, library, words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD * 2)], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, queries.vocabulary(), lexicon_words=words)
    for r in bpe.decode(encoded, queries.vocabulary()).collect():
        ids, text = expected(library, ODD[r.doc_id % len(ODD)])
        assert (r.ids, r.decoded) == (ids, text)
    assert bpe.encode(docs.limit(0), queries.vocabulary()).count() == 0


def test_automaton_shares_suffixes_and_finds_exactly_its_words():
    words = sorted({f"{a}{b}ing" for a in ("", "th", "st") for b in "abcdefgh"} | {"a", "ab", "é"})
    lexicon = bpe.Lexicon.map(bpe.Lexicon.compile({w.encode(): [i, i + 1][: i % 3] for i, w in enumerate(words)}))
    # one state per distinct set of endings, far fewer than the letters of all words
    assert len(lexicon.final) < sum(map(len, words)) / 3
    asked = [*words, "", "thaing", "xing", "abc", "ain", "ainga"]
    import numpy as np

    raw = np.frombuffer("".join(asked).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(w.encode()) for w in asked)])
    byte_order = sorted(words, key=str.encode)
    assert lexicon.find(raw, bounds).tolist() == [byte_order.index(w) if w in words else -1 for w in asked]
    for w, at in zip(words, lexicon.find(raw, bounds)):
        i = words.index(w)
        assert lexicon.ids[lexicon.starts[at] : lexicon.starts[at + 1]].tolist() == [i, i + 1][: i % 3]


def test_decode_skips_unknown_ids_and_null_lists(spark):
    rows = spark.createDataFrame([(1, [3306, -1, 49407, 10**6, 1002]), (2, None), (3, [])], "k long, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(rows, queries.vocabulary()).collect()}
    assert got == {1: "hello</w> <|endoftext|> world</w>", 2: "", 3: ""}
