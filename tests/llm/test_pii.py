import hashlib
import math
import re
import time
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii, queries

FOLDER = "/root/testdata/sf0.01"


def matches(text):
    """The patterns of the contract, written out once more."""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text):
        if max(map(int, m[0].split("."))) <= 255:
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def words_of(text, spans):
    """(start, end, term) of the words that no span touches."""
    found = [(m.start(), m.end()) for m in re.finditer("[^ \t-\r]+", text)]
    return found, [(a, b, pii.term_of(text[a:b])) for a, b in found if not any(a < y and x < b for _, x, y in spans)]


def brute_terms(texts):
    """Disclosing words by counting every document, as (place in texts, start, end)."""
    df, both, seen, holders, free = Counter(), Counter(), defaultdict(set), Counter(), []
    for i, text in enumerate(texts):
        df.update({pii.term_of(w) for w in re.split("[ \t-\r]+", text)})
        spans = matches(text)
        words, rest = words_of(text, spans)
        by_term = defaultdict(set)
        for a, _, term in rest:
            by_term[term] |= {kind for kind, *_ in spans}
        for kind, a, b in spans:
            name = pii.entity(kind, text[a:b])
            line = (text.rfind("\n", 0, a), text.find("\n", a) % (len(text) + 1))
            ahead, behind = [w for w in words if w[0] < a], [w for w in words if w[0] >= b]
            touched = [w for w in words if a <= w[0] < b]
            close = {*ahead[-pii.WINDOW - 1 :], *touched, *behind[: pii.WINDOW]}
            for x, y, term in rest:
                if (x, y) in close and line[0] < x < line[1]:
                    by_term[term].add(name)
        holders.update({kind for kind, *_ in spans} | {pii.entity(k, text[a:b]) for k, a, b in spans})
        for term, entities in by_term.items():
            for e in entities:
                both[e, term] += 1
                seen[e, term].add(text)
        free.append((rest, by_term))
    found = set()
    for i, (rest, by_term) in enumerate(free):
        for a, b, term in rest:
            for e in by_term[term] if term else ():
                ic = math.log2(len(texts) / holders[e])
                if ic <= 0 or (e in pii.KINDS and len(seen[e, term]) < 2):
                    continue
                if math.log2(len(texts) * both[e, term] / ((df[term] + pii.SMOOTHING) * holders[e])) / ic >= pii.GENERALISE_AT:
                    found.add((i, a, b))
    return found


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    terms = defaultdict(list)
    for i, a, b in sorted(brute_terms(texts)):
        terms[rows[i].doc_id].append(f"term:{a}:{b}")
    got = {r.doc_id: r for r in queries.op5_pii(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    assert sum(map(len, terms.values())) > 50
    for r, text in zip(rows, texts):
        base = matches(text)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        mine = got[r.doc_id]
        counts = Counter(k for k, *_ in base)
        assert [mine.n_email, mine.n_ip, mine.n_card, mine.n_phone] == [counts[k] for k in pii.KINDS]
        assert mine.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert mine.spans == ",".join([*listed, *terms[r.doc_id]])


def test_disclosing_terms_are_generalised_or_removed(spark):
    filler = [(100 + i, f"the plain text number {i} of the corpus", "x") for i in range(40)]
    rows = [
        (1, "Ask Zorblax, the owner: zor@example.com today", "x"), (2, "Write Zorblax at ZOR@example.com now", "x"),
        (3, "Ask the 10.0.0.1 host", "x"), (3, "Ask the 10.0.0.1 host", "x"), (4, None, None), (5, "", "x"),
        (None, "+44 (0)20 7946-0958 x999.1.1.1; 4111 1111 1111 1111 ünï 1.2.3.4@a.b", "x"),
    ]
    docs = spark.createDataFrame(rows + filler, "doc_id long, text string, near string")
    got = [(r.doc_id, r.text) for r in pii.sanitise(docs).collect()]
    clean = dict(got)
    assert clean[1] == "Ask <name> the owner: <email> today" and clean[2] == "Write <name> at <email> now"
    assert clean[3] == "Ask the <ip> <word>" and [i for i, _ in got].count(3) == 2
    assert clean[4] is None and clean[5] == "" and clean[100] == filler[0][1]
    assert clean[None] == "<phone> x999.1.1.1; <card> ünï <email>"
    assert pii.find(docs.limit(0)).count() == 0


def test_words_near_a_match_stay_in_its_line():
    text = "far away\none two mail@a.bc, three\nnext line"
    spans = pii.base_spans(text)
    words, _ = pii.covered_words(text, spans)
    found = pii.near_words(text, spans, words)
    assert [pii.term_of(text[slice(*words[i])]) for i in sorted(found)] == ["one", "two", "mail@a.bc", "three"]


def test_nearly_exclusive_terms_are_removed_everywhere_in_their_documents(spark):
    rows = [(i, f"Zorblax wrote number {i} to zor@example.com.\nZorblax again", "x") for i in range(60)]
    rows += [(100 + i, f"plain text {i} of the corpus", "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[7] == "   7  <email>.\n " and clean[107] == "plain text 7 of the corpus"


def test_long_texts_take_time_in_proportion(spark):
    texts = [
        "1" * 600_000 + "." + "2" * 400_000,
        "a" * 1_000_000 + "@",
        "a@" * 500_000,
        "+1" + "(" * 1_000_000,
        "+1" * 500_000,
        "1.2.3." * 160_000,
        "A1b2" * 250_000,
        "0" * 5_000 + "1.2.3.4 and " + "9" * 5_000 + ".1.1.1",
    ]
    for text in texts[:-1]:
        started = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - started < 3
    assert pii.base_spans(texts[-1]) == [("ip", 0, 5007)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.digests(pii.find(docs)).count() == len(texts)


def test_rows_of_a_long_document_are_counted_once(spark, monkeypatch):
    rows = [(i, f"alpha {i} zor{i % 4}@example.com beta gamma alpha", "x") for i in range(8)]
    rows += [(100 + i, f"plain text {i} of the corpus", "x") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head string")
    want = sorted((r.doc_id, str(r.terms)) for r in pii.find(docs).collect())
    monkeypatch.setattr(pii, "WORDS_AT_ONCE", 2)
    assert sorted((r.doc_id, str(r.terms)) for r in pii.find(docs).collect()) == want
    assert any("start" in t for _, t in want)


@settings(max_examples=300, deadline=None)
@given(st.text("ab1 .@%+-()0\n4", max_size=60))
def test_matches_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == matches(text)
