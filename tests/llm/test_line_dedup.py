import re
from collections import defaultdict

from millrace.llm import line_dedup, queries

FOLDER = "/root/testdata/sf0.01"
L, S = line_dedup.LEADING, line_dedup.STRETCHES


def templates(line):
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line.strip(" \t\x0b\f\r"))]
    n = len(tokens)
    if not line or n < line_dedup.MIN_TOKENS:
        return []
    found = [(-1, tuple(tokens))]
    if n >= line_dedup.MIN_OPEN_TOKENS:
        for k in range(S):
            a, b = (int(j * (n - L) / S) + L for j in (k, k + 1))
            found.append((k, tuple(tokens[:a]), tuple(tokens[b:]), n))
    return found


def brute_force(rows):
    """rows: (id, text) with distinct ids; the text left of each and the number of dropped lines."""
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for line in (text or "").split("\n"):
            for t in templates(line):
                first.setdefault(t, i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if all(first[t] == i for t in templates(x))]
        out[i] = ("\n".join(stay) if len(stay) < len(lines) else text, len(lines), len(lines) - len(stay))
    return out


def answers(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = queries.op3_line_dedup(spark, FOLDER)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert answers(got) == brute_force(rows)


def test_variable_fields_copies_and_odd_rows(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    other = passage.replace("wordaa", "wordaa").replace("wordgb", "changed")
    rows = [
        (3, f"Own line of three\n{passage}", "x"),
        (1, f"Error 17 at node a7\n{other}\nA b", "x"),
        (2, "Error 18 at node b9\n\n\nTail here stays put\nA b", None),
        (4, f"Own line of three\n{passage}", "z"),
        (5, None, None), (6, "", "q"), (7, "   ", "q"),
        (None, "Error 19 at node c1\nx y z unique", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf string")
    left = line_dedup.dedup_lines(docs)
    assert left.columns == ["doc_id", "text", "leaf", "_n_lines", "_n_dropped"]
    got = {r.doc_id: (r.text, r._n_lines, r._n_dropped) for r in left.collect()}
    assert got == brute_force([r[:2] for r in rows])
    assert got[1] == (rows[1][1], 3, 0) and got[3] == ("Own line of three", 2, 1) and got[4] == ("", 2, 2)
    assert got[2] == ("\n\nTail here stays put\nA b", 5, 1) and got[None][0] == "x y z unique" and got[5] == (None, 1, 0)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document_and_threshold(spark):
    line = "one two three four"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (3, f"{line}\n{line}")], "doc_id long, text string")
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id].append(r.text)
    assert got == {1: [line, line], 2: [""], 3: [""]}
    assert {r._n_dropped for r in line_dedup.dedup_lines(docs, min_docs=4).collect()} == {0}


def test_lines_of_numbers_meet_only_when_equal(spark):
    long = " ".join(f"{i}.5" for i in range(20))
    rows = [
        (1, f"2021-01-03 14:22 17.5\nTotal 1 2 3\n{long}\nError 17 at node a7"),
        (2, f"2021-01-04 09:10 3.25\nTotal 4 5 6\n{long}1\nError 18 at node a8"),
        (3, f"2021-01-04  09:10 3.25\nTotal 7 8 9\n{long}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: f"2021-01-04 09:10 3.25\nTotal 4 5 6\n{long}1", 3: "Total 7 8 9"}
