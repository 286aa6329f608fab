"""CSV rows cut by many tasks, against Python's own reader."""

import csv
import io
import random

import pytest

from millrace.sources import csv_rows
from millrace.sources.csv_split import ends_quoted, split_rows


def write(rng, path, n, **form):
    out = io.StringIO()
    writer = csv.writer(out, **form)
    writer.writerow(["a", "b", "c"])
    cells = ["x", 'say "hi"', "two\nlines", ',"\n,"', "é漢", "", '""', "plain text", "\n\n", "q\"", "a b"]
    for i in range(n):
        writer.writerow([i, rng.choice(cells), rng.choice(cells) * rng.randint(1, 9)])
    path.write_text(out.getvalue(), newline="")
    return out.getvalue()


@pytest.mark.parametrize("form", [{}, {"quoting": csv.QUOTE_ALL}, {"lineterminator": "\n"}])
def test_rows_are_those_of_a_whole_reader(spark, tmp_path, form):
    rng = random.Random(len(form))
    paths = [tmp_path / f"f{i}.csv" for i in range(3)]
    texts = [write(rng, p, 60, **form) for p in paths]
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = split_rows(spark, [str(p) for p in paths], range_bytes=300).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for path, text in zip(paths, texts):
        own = sorted((r.number, r.value) for r in rows if r.file.endswith(path.name))
        got = [next(csv.reader(io.StringIO(v, newline=""))) for _, v in own]
        assert got == [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert [n for n, _ in own] == list(range(61))


def test_large_and_small_files_give_the_same_rows(spark, tmp_path):
    rng = random.Random(9)
    for i in range(3):
        write(rng, tmp_path / f"f{i}.csv", 40 + 200 * (i == 1), lineterminator="\n")
    read = lambda **kw: csv_rows.read_csv_rows(spark, str(tmp_path), "a int, b string, c string", **kw)
    plain = sorted(str((r.source_file, r.row)) for r in read().collect())
    for over in (0, 3000):
        assert sorted(str((r.source_file, r.row)) for r in read(split_over=over, range_bytes=700).collect()) == plain
    assert len(plain) == 320
    with pytest.raises(ValueError, match="schema"):
        csv_rows.read_csv_rows(spark, str(tmp_path), split_over=0)


def test_where_quotes_count():
    for line, entered, want in [
        (b"a,b", False, False), (b"a,b", True, True), (b'"a', False, True), (b'a"b,c"', False, False), (b'x","y', True, True),
        (b'"a""b', False, True), (b'"a"""', False, False), (b'"a"b"c,d', False, False), (b'""', True, True), (b'",', True, False),
        (b',"', False, True), (b'"",""', False, False),
    ]:
        assert ends_quoted(line, entered) == want, line
