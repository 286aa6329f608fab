import pytest

import __spark_entry__ as entry
from millrace.queries import files
from millrace.sources import csv_rows, jsonl


@pytest.mark.parametrize("name, module, reader", [("large_csv", csv_rows, "read_csv_rows"), ("large_documents", jsonl, "read_json_items")])
def test_files_grow_in_number_with_the_rows(spark, tmp_path, monkeypatch, name, module, reader):
    spark.sql(
        "SELECT id AS doc_id, 's' AS source, concat('a, \"b\" [', id) AS text, 'en' AS lang, 9L AS n_chars FROM range(45)"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(files, "PART_ROWS", 5, raising=False)
    read, counts = getattr(module, reader), []

    def counted(session, folder, *args, **kwargs):
        counts.append(session.read.format("binaryFile").load(folder).count())
        return read(session, folder, *args, **kwargs)

    monkeypatch.setattr(module, reader, counted)
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert min(counts) > 4
    text = "text" if name == "large_csv" else "content"
    assert sorted((r.doc_id, r[text]) for r in rows) == sorted((i, f'a, "b" [{i}') for i in range(45) for _ in counts)
