"""Files of every kind through the end-to-end conversions."""

import json

import pytest

from millrace import sinks
from millrace.plans import csv_to_requests, directory_to_requests, json_to_requests, vision_to_requests
from millrace.sources import jsonl


def lines(conversion, tmp_path):
    out = str(tmp_path / "requests")
    conversion.write(out)
    return [json.loads(r.value) for r in conversion.rows.sparkSession.read.text(out).collect()]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_jsonl_reading(spark, tmp_path):
    good = put(tmp_path / "good.jsonl", '# note\n\n{"a": 1}\n  {"a": 2}  \n7\n')
    bad = put(tmp_path / "bad.jsonl", '{"a": 3}\n{"a": \n{"a": 4} junk\n{"a": 5}\n')
    assert jsonl.validate_jsonl(spark, good) is True
    assert jsonl.validate_jsonl(spark, bad) is False
    assert jsonl.validate_jsonl(spark, str(tmp_path / "none.jsonl")) is False
    assert jsonl.validate_jsonl(spark, put(tmp_path / "empty.jsonl", "")) is True
    texts = [r.line for r in jsonl.read_jsonl(spark, bad).orderBy("seq").collect()]
    assert texts == ['{"a": 3}', '{"a": 5}']
    merged = jsonl.merge_jsonl(spark, [bad, str(tmp_path / "none.jsonl"), good, bad])
    assert [r.line for r in merged.orderBy("seq").collect()] == [
        '{"a": 3}', '{"a": 5}', '{"a": 1}', '{"a": 2}', "7", '{"a": 3}', '{"a": 5}',
    ]
    assert jsonl.count_requests(spark, good).first().requests == 5
    assert jsonl.merge_jsonl(spark, [str(tmp_path / "none.jsonl")]).count() == 0
    with pytest.raises(Exception, match="invalid JSON line"):
        jsonl.read_prompt_pool(spark, bad).collect()


def test_merge_keeps_order_of_many_splits(spark, tmp_path):
    wanted = [json.dumps({"n": i, "pad": "x" * 50}) for i in range(3000)]
    path = put(tmp_path / "many.jsonl", "\n".join(wanted))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        merged = jsonl.merge_jsonl(spark, [path])
        assert merged.rdd.getNumPartitions() > 1
        assert [r.line for r in merged.orderBy("seq").collect()] == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_array_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"id": i, "v": "a,b]"})) for i in range(50)], "seq int, line string")
    out = tmp_path / "array"
    sinks.write_json_document(rows.repartition(7), str(out), "seq")
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert json.loads(text) == [{"id": i, "v": "a,b]"} for i in range(50)]
    back = [json.loads(r.line)["id"] for r in sinks.read_json_document(spark, str(out)).collect()]
    assert sorted(back) == list(range(50))
    sinks.write_json_document(rows.limit(0), str(tmp_path / "none"), "seq")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


def test_json_documents(spark, tmp_path):
    users = [{"id": i, "name": f"n{i}"} for i in range(3)]
    nested = put(tmp_path / "nested.json", json.dumps({"users": users, "settings": {"theme": "x"}}))
    conversion = json_to_requests(spark, nested, json_key="users", model="m")
    assert conversion.report().first().asDict() == {
        "total": 3, "successful_conversions": 3, "failed_conversions": 0,
    }
    got = lines(conversion, tmp_path)
    assert [g["custom_id"] for g in got] == ["0", "1", "2"]
    assert [json.loads(g["body"]["messages"][0]["content"]) for g in got] == users
    assert got[0]["body"]["messages"][0]["content"] == json.dumps(users[0])
    assert got[0]["metadata"] == {"original_item": users[0], "source_file": nested}
    errors = {
        "Key 'nope' not found in JSON": json_to_requests(spark, nested, json_key="nope"),
        "JSON decode error": json_to_requests(spark, put(tmp_path / "bad.json", "{not json}")),
        "Unsupported JSON format": json_to_requests(spark, put(tmp_path / "s.json", '"just a string"')),
    }
    for message, conversion in errors.items():
        (failure,) = conversion.failures.collect()
        assert failure.error.startswith(message)
    single = json_to_requests(spark, put(tmp_path / "one.json", '{"id": 9, "prompt": "p"}'))
    assert single.report().first().total == 1
    strings = json_to_requests(spark, put(tmp_path / "strs.json", '["first", "second {x}"]'))
    assert [r["body"]["messages"][0]["content"] for r in lines(strings, tmp_path / "s")] == ["first", "second {x}"]


def test_csv(spark, tmp_path):
    path = put(tmp_path / "people.csv", 'name,age,job,day\nAnn,30,"dev, lead",2024-01-02\nBob,,NA,2024-01-03\n')
    conversion = csv_to_requests(
        spark, path, prompt_template="{name} ({age}) is {job} on {day}{none}", system_prompt="s", model="m",
        id_column="name", api_parameters={"temperature": 0.1, "top_p": 0.5},
    )
    got = {g["custom_id"]: g for g in lines(conversion, tmp_path)}
    assert got["Ann"]["body"]["messages"] == [
        {"role": "system", "content": "s"},
        {"role": "user", "content": "Ann (30) is dev, lead on 2024-01-02"},
    ]
    assert got["Bob"]["body"]["messages"][1]["content"] == "Bob (nan) is nan on 2024-01-03"
    assert got["Ann"]["body"]["temperature"] == 0.1 and got["Ann"]["body"]["max_tokens"] == 500
    assert got["Ann"]["metadata"]["source_file"] == path
    assert got["Ann"]["metadata"]["csv_row"]["age"] == 30
    absent = csv_to_requests(spark, path, prompt_column="nope")
    assert absent.report().first().failed_conversions == 2
    clash = csv_to_requests(spark, path, prompt_column="name", api_parameters={"model": "x"})
    assert clash.report().first().failed_conversions == 2
    with pytest.raises(ValueError):
        csv_to_requests(spark, path)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    put(root / "file1.txt", "one\r\ntwo")
    put(root / "data.json", "{}")
    put(root / "image.jpg", b"\xff\xd8\xff")
    put(root / "subdir1" / "file2.txt", "2")
    put(root / "subdir2" / "file3.txt", "3" * 50)
    put(root / "noext", "never")
    return str(root)


def test_text_folder(spark, tree, tmp_path):
    count = lambda **kw: directory_to_requests(spark, tree, **kw).report().first().total
    assert count() == 5
    assert count(extensions=["txt"]) == 3
    assert count(recursive=False) == 3
    assert count(extensions=[".zip"]) == 0
    assert count(exclude_patterns=["subdir1/*"]) == 4
    assert count(file_pattern="*.txt") == 3
    small = directory_to_requests(spark, tree, max_file_size=10, prompt_template="> {content}")
    assert small.report().first().asDict() == {
        "total": 5, "successful_conversions": 4, "failed_conversions": 1,
    }
    got = {g["metadata"]["source_file"].rsplit("/", 1)[1]: g for g in lines(small, tmp_path)}
    assert got["file1.txt"]["body"]["messages"][0]["content"] == "> one\ntwo"
    assert got["file1.txt"]["metadata"] == {
        "source_file": f"{tree}/file1.txt", "file_size": 8, "file_extension": ".txt",
    }
    assert got["image.jpg"]["body"]["messages"][0]["content"] == "> " + b"\xff\xd8\xff".decode("utf-8", "replace")
    strict = directory_to_requests(spark, tree, prompt_template="{other}")
    assert strict.report().first().failed_conversions == 5


def test_oversized_files_are_not_opened(spark, tree, monkeypatch):
    # where only Spark's reader gets at the files; what tasks read themselves is in test_tree.py
    monkeypatch.setattr("millrace.sources.tree.reachable", lambda path: False)
    plan = directory_to_requests(spark, tree, max_file_size=10).rows._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,10)" in plan


def test_image_folder(spark, tmp_path):
    root = tmp_path / "images"
    for name in ("a.png", "b.jpg", "c.jpeg", "d.gif", "e.webp", "f.bmp", "notes.txt", "IMG_1.JPG"):
        put(root / name, b"\x89" * 100)
    put(root / "deep" / "g.png", b"1" * 5008)
    found = lambda **kw: vision_to_requests(spark, str(root), **kw).report().first().found
    assert found() == 7
    assert found(file_pattern="**/*.png") == 2
    assert found(file_pattern="*.{png,gif}") == 2
    assert found(file_pattern="*.tiff") == 0
    conversion = vision_to_requests(
        spark, str(root), file_pattern="**/*.png", max_image_size=1000,
        prompts={"a.png": "Is this {a} cat?"}, system_prompt="s",
    )
    assert conversion.report().first().asDict() == {
        "found": 2, "converted": 1, "skipped_too_large": 1, "failed": 0,
    }
    (got,) = lines(conversion, tmp_path)
    text, image = got["body"]["messages"][1]["content"]
    assert text == {"type": "text", "text": "Is this {a} cat?"}
    import base64

    assert image["image_url"]["url"] == "data:image/png;base64," + base64.b64encode(b"\x89" * 100).decode()
    assert got["custom_id"] == "a"
    assert got["metadata"] == {"filepath": "a.png", "filename": "a.png", "size": 100}
    single = vision_to_requests(spark, str(root / "notes.txt"))
    assert single.report().first().converted == 1


def test_full_path_prompt_beats_file_name(spark, tmp_path):
    path = put(tmp_path / "i" / "a.png", b"x")
    conversion = vision_to_requests(spark, str(tmp_path / "i"), prompts={"a.png": "name", path: "path"})
    (got,) = lines(conversion, tmp_path)
    assert got["body"]["messages"][0]["content"][0]["text"] == "path"
