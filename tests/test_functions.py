"""Column functions against the Python behaviour they stand for."""

import fnmatch
import os
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import jobs as J
from millrace.functions import paths as P
from millrace.functions import templates
from millrace.functions import text as X
from millrace.functions import variants as V
from millrace.functions.errors import error_category


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.withColumn("x", expr(F.col("v"))).orderBy("i").collect()]


NAMES = ["/a/b.txt", "/a/.hidden", "/a/..two", "/a/x.tar.gz", "/a/name.", "/a/plain", "/a/.h.txt", "/a.b/c", "/a/IMG.JPG"]


def test_file_names(spark):
    assert column(spark, NAMES, "string", P.basename) == [os.path.basename(n) for n in NAMES]
    assert column(spark, NAMES, "string", P.extension) == [os.path.splitext(n)[1] for n in NAMES]
    assert column(spark, NAMES, "string", P.stem) == [
        os.path.splitext(os.path.basename(n))[0] for n in NAMES
    ]
    no_end_dot = [n for n in NAMES if not n.endswith(".")]
    assert column(spark, no_end_dot, "string", P.suffix) == [pathlib.PurePosixPath(n).suffix for n in no_end_dot]


def test_mime_types(spark):
    assert column(spark, ["a.PNG", "b.jpeg", "c.txt", "d"], "string", P.mime_type) == [
        "image/png", "image/jpeg", "application/octet-stream", "application/octet-stream",
    ]


@pytest.mark.parametrize("pattern", ["*.txt", "build/*", "b/?.txt", "/a/b/*", "[cd].txt", "[!c].txt", "a/*/c.txt"])
def test_exclude_patterns_match_like_paths(spark, pattern):
    paths = ["/a/b/c.txt", "/a/b/d.txt", "/x/build/o.md", "/a/b/cc.txt", "/a/b/e.md"]
    got = column(spark, paths, "string", lambda c: c.rlike(P.right_anchored_regex(pattern)))
    assert got == [pathlib.PurePosixPath(p).match(pattern) for p in paths]


def test_globs(spark):
    paths = ["a.png", "d/a.png", "d/e/a.png", "a.PNG", "b.jpg"]
    hits = column(spark, paths, "string", lambda c: c.rlike(P.glob_regex("**/*.png")))
    assert hits == [True, True, True, False, False]
    hits = column(spark, paths, "string", lambda c: c.rlike(P.glob_regex("*.png")))
    assert hits == [fnmatch.fnmatchcase(p, "*.png") and "/" not in p for p in paths]
    assert P.expand_braces("*.{jpg,png}") == ["*.jpg", "*.png"]
    assert P.expand_braces("*.jpg") == ["*.jpg"]


def test_strip_like_python(spark):
    values = ["  a ", "\t　b ", "\x1cc\xa0", "", "d e"]
    assert column(spark, values, "string", X.strip) == [v.strip() for v in values]


def test_floats_print_like_python(spark):
    values = [0.0, -0.0, 1.0, 900.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 1e-5, -2.5e-7, 123456789012.25, 1e100]
    assert column(spark, values, "double", X.float_text) == [str(v) for v in values]
    odd = [float("nan"), float("inf"), float("-inf")]
    assert column(spark, odd, "double", X.float_text) == [str(v) for v in odd]


def test_scalar_text(spark):
    assert column(spark, [True, None], "boolean", lambda c: X.scalar_text(c, T.BooleanType())) == ["True", "nan"]


def test_decode(spark):
    raws = ["plain\r\nline\rx".encode(), b"bad\xff\r\nkept", "é中".encode()]
    want = ["plain\nline\nx", b"bad\xff\r\nkept".decode("utf-8", "replace"), "é中"]
    assert column(spark, raws, "binary", X.decode_text) == want


def test_variant_texts(spark):
    texts = ["null", "true", "5", '"s"', "[1,2]", '{"a":1}', "0", '""', "[]", "{}"]
    parsed = lambda f: (lambda c: f(F.parse_json(c)))
    assert column(spark, texts, "string", parsed(V.kind)) == [
        "null", "boolean", "number", "string", "array", "object", "number", "string", "array", "object",
    ]
    assert column(spark, texts, "string", parsed(V.truthy)) == [
        False, True, True, True, True, True, False, False, False, False,
    ]
    assert column(spark, texts[:4], "string", parsed(V.value_text)) == ["None", "True", "5", "s"]
    assert column(spark, texts[:4], "string", parsed(V.number_or_null)) == [None, 1.0, 5.0, None]


def test_later_key_wins(spark):
    row = spark.range(1).select(F.to_json(V.parse_object(F.lit('{"a":1,"b":2,"a":null}'))).alias("x")).first()
    assert row.x == '{"a":null,"b":2}'


def test_error_categories(spark):
    texts = ["Read TIMEOUT", "timed out", "HTTP 429", "Rate Limit hit", "code 1503x", "Server down",
             "ValueError: x", "unsupported url: /a", "model does not match", None, ""]
    assert column(spark, texts, "string", error_category) == [
        "timeout", "timeout", "rate_limit", "rate_limit", "server", "server", "validation", "validation",
        "other", "other", "other",
    ]


def render(spark, template, cells, missing=None):
    row = spark.createDataFrame([tuple(cells.values())], list(cells))
    out = templates.render(
        template, {n: F.col(n).cast("string") for n in cells}, {n: F.col(n) for n in cells}, missing
    )
    return tuple(row.select(out.text.alias("t"), out.error.alias("e")).first())


@pytest.mark.parametrize("template", ["{a} and {b}", "{{{a}}} }}", "{a:>5}|{b!r}", "{b[0]}", "no fields", "{a:05d}{a}"])
def test_templates_like_format(spark, template):
    cells = {"a": 7, "b": "text"}
    assert render(spark, template, cells, "") == (template.format(**cells), None)


def test_template_failures(spark):
    cells = {"content": "c"}
    assert render(spark, "x {other} y", cells, "")[0] == "x  y"
    for template in ["{other}", "{}", "{0}", "{a.b}", "{content", "{other[0]}"]:
        text, error = render(spark, template, cells)
        assert text is None and error


def test_job_values(spark):
    states = ['{"current":["completed"]}', '"running"', '["pending"]', '{"CURRENT":"failed"}', '" "', "[]",
              '{"current":[]}', "5", '{"current":"", "CURRENT":["x"]}']
    got = column(spark, states, "string", lambda c: J.job_state(F.parse_json(F.concat(F.lit('{"state":'), c, F.lit("}")))))
    assert got == ["COMPLETED", "RUNNING", "PENDING", "FAILED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "X"]
    first = spark.range(1).select(J.job_state(F.parse_json(F.lit('{"job_state":"a","state":"b"}'))).alias("s")).first()
    assert first.s == "A"
    stamps = ["1700000000", "0", '"2024-01-02T03:04:05Z"', '"2024-01-02T03:04:05+02:00"', '"2024-01-02"', '"20240102"',
              '"x"', '"2024"', "null", '""', "1700000000.9"]
    got = column(spark, stamps, "string", lambda c: J.timestamp_text(F.parse_json(c)))
    assert got == ["2023-11-14 22:13:20", "--", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 00:00:00",
                   "2024-01-02 00:00:00", "--", "--", "--", "--", "2023-11-14 22:13:20"]
    assert column(spark, [3661.9, 0.0, 360000.0, None], "double", J.duration_text) == ["01:01:01", "--", "100:00:00", "--"]
    limits = ["90", '{"set":true,"infinite":false,"number":61}', '{"set":false,"number":5}',
              '{"set":true,"infinite":true,"number":5}', '"90"', "null", "0"]
    got = column(spark, limits, "string", lambda c: J.minutes_text(J.limit_minutes(F.parse_json(c))))
    assert got == ["01:30:00", "01:01:00", "--", "--", "--", "--", "--"]
    assert column(spark, ["1-02:03:04", "00:00:10", "bad", "1:2", ""], "string", J.elapsed_seconds) == [93784.0, 10.0, 0.0, 0.0, 0.0]
    assert column(spark, ["80GB", "8gb", "GB", None], "string", J.gigabytes) == [80, None, None, None]
    picked = spark.range(1).select(J.first_text(F.lit(" "), F.lit(None), F.lit(" v ")).alias("a"), J.first_text(F.lit("")).alias("b")).first()
    assert tuple(picked) == ("v", "--")
