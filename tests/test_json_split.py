"""Large JSON documents cut by many tasks, against json.loads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import json_split, jsonl
from millrace.sources.jobs import read_accounting, read_registry


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def value(rng, depth=0):
    texts = ["", "a,b", 'q"uo,te', "back\\slash\\", "[x,", "}],{", "é漢😀,", "line\nend", "plain", "\\,\\\\,"]
    kinds = 5 if depth > 2 else 7
    return [
        lambda: rng.choice(texts), lambda: rng.randint(-9, 10**12), lambda: None, lambda: rng.choice([True, False]),
        lambda: 0.5, lambda: [value(rng, depth + 1) for _ in range(rng.randint(0, 4))],
        lambda: {rng.choice(texts) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))},
    ][rng.randrange(kinds)]()


def dump(rng, doc):
    return json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))


def expected(text, key=None):
    """(pos, element) of each item, or the error."""
    try:
        doc = json.loads(text)
    except ValueError:
        return "JSON decode error"
    if key is not None:
        if not isinstance(doc, dict) or key not in doc:
            return f"Key '{key}' not found in JSON"
        doc = doc[key]
    if isinstance(doc, list):
        return list(enumerate(doc))
    return [(0, doc)] if isinstance(doc, dict) else "Unsupported JSON format"


def read(spark, paths, key=None):
    rows = jsonl.read_json_items(spark, paths, key, split_over=0)
    found = {}
    for r in rows.select("source_file", "seq.pos", "error", F.to_json("item").alias("item"), "raw").collect():
        if r.error is not None:
            found[r.source_file] = r.error
            continue
        item = json.loads(r.item)
        assert r.raw is None or json.loads(r.raw) == item
        found.setdefault(r.source_file, []).append((r.pos, item))
    return {f: v if isinstance(v, str) else sorted(v, key=lambda p: p[0]) for f, v in found.items()}


def check(spark, folder, texts, key=None):
    paths = []
    for i, text in enumerate(texts):
        path = folder / f"d{i}.json"
        path.write_bytes(text.encode())
        paths.append(str(path))
    found = read(spark, paths, key)
    for path, text in zip(paths, texts):
        want = expected(text, key)
        got = found.get(path, [])
        assert got == want or (isinstance(want, str) and isinstance(got, str) and got.startswith(want)), (text, got, want)


def test_arrays_against_the_whole_document(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    texts = [dump(rng, [value(rng) for _ in range(rng.randint(0, 20))]) for _ in range(6)]
    texts += [" [ ] ", "[1]", "[\n]", '\n["x, y", {"a": [1, 2]}]\n', '["' + "long, " * 90 + '"]', json.dumps([["é,漢"] * 40, {}])]
    check(spark, tmp_path, texts)


def test_members_against_the_whole_document(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    texts = []
    for _ in range(7):
        doc = {f"k{i}": value(rng) for i in range(rng.randint(0, 5))}
        if rng.random() < 0.8:
            doc["items"] = [value(rng) for _ in range(rng.randint(0, 12))]
        doc |= {f"z{i}": [value(rng) for _ in range(rng.randint(0, 6))] for i in range(rng.randint(0, 3))}
        texts.append(dump(rng, doc))
    texts += [
        "{}", '{"items": []}', '{"items": {"a": [1, 2]}}', '{"items": 5}', '{"items": [1, 2], "items": [3, 4, 5]}',
        '{"items": [1, 2], "x": 1, "items": "text"}', '{"it\\u0065ms": [1, {"a": 2}]}', '{"a": {"items": [1, 2]}, "b": [{"items": [3, 4]}, 5]}',
        "[1, 2]", '{"x": [[1, 2], [3, 4]], "items" : [[1, 2], [3, 4]]}',
    ]
    check(spark, tmp_path, texts, "items")


def test_broken_documents_are_refused(spark, tmp_path, small_ranges):
    arrays = ["[1, 2", "[1, 2],", "[1,, 2]", "[1, 2,]", "[, 1]", "[1], [2]", '["a, 2]', "[1 2]", "[1, 2]]", "[1}, {2]", "[1, 2] x", '[{"a": 1, 2]', "[01, 2]"]
    objects = [
        '{"items": [1, 2]', '{"items": [1, 2]},', '{"items": [1, , 2]}', '{"items": [, 1]}', '{"items": [1, 2, ]}', '{"items": [1, 2] 3}',
        '{"items": [1, 2], }', '{"a": 1, "items": [1, 2], b: 3}', '{"items": [1, 2}, "c": 3]', '{"a": [1, 2]}, {"items": [3, 4]}',
        '{"a": [1, nul], "items": [1, 2]}', '{"a" 1, "items": [1, 2]}', '{"items": [1, 2]]', '{, "items": [1, 2]}',
    ]
    for i, (texts, key) in enumerate(((arrays, None), (objects, "items"))):
        assert all(expected(t, key) == "JSON decode error" for t in texts)
        folder = tmp_path / str(i)
        folder.mkdir()
        check(spark, folder, texts, key)


def test_documents_of_any_text_are_judged_as_a_whole(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    alphabet = ["[", "]", "{", "}", ",", ":", '"', "\\", "1", '"a"', '"items":', " ", "[1,2]", '"x,y"', "null"]
    for i, (opening, key) in enumerate((("[", None), ("{", "items"), ('{"items":[', "items"))):
        texts = [opening + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) + rng.choice(["]", "}", "]}", ""]) for _ in range(30)]
        folder = tmp_path / str(i)
        folder.mkdir()
        check(spark, folder, texts, key)


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    items = [{"id": i, "text": "with, commas and \"quotes\" " * (i % 9), "list": [i, [i]]} for i in range(20_000)]
    path = tmp_path / "large.json"
    path.write_text(json.dumps(items, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 7))
    try:
        assert json_split._records(spark, [str(path)]).rdd.getNumPartitions() >= 7
        rows = jsonl.read_json_items(spark, str(path), split_over=1 << 16)
        got = rows.select("seq.pos", F.try_variant_get("item", "$.id", "int").alias("id"), F.try_variant_get("item", "$.text", "string").alias("text"))
        assert [tuple(r) for r in got.orderBy("pos").collect()] == [(i, x["id"], x["text"]) for i, x in enumerate(items)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_job_files_are_cut_like_parsed_as_a_whole(spark, tmp_path, small_ranges):
    entries = {str(100 + i): {"job_name": f"n,{i}", "model": "m", "submitted_at": 1_700_000_000 + i, "x": [1, {"y": 2}]} for i in range(12)}
    registry = tmp_path / "jobs.json"
    registry.write_text(json.dumps(entries)[:-1] + ', "100": {"job_name": "again"}}')
    jobs = [{"job_id": 100 + i % 9, "job_state": ["RUNNING"], "name": f"a,{i}"} for i in range(12)] + [7, {"job_id": 0}]
    accounting = tmp_path / "acct.json"
    accounting.write_text(json.dumps({"meta": {"v": [1, 2]}, "jobs": jobs, "errors": []}))
    for read, path in ((read_registry, registry), (read_accounting, accounting)):
        whole = sorted(read(spark, str(path)).collect(), key=str)
        assert sorted(read(spark, str(path), split_over=10).collect(), key=str) == whole and len(whole) > 8
