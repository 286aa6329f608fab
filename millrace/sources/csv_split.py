"""Large CSV files with line breaks in their cells, read by many tasks (S3).

A line break ends a row unless it stands in a quoted cell, which depends on all lines before it. Byte ranges are read line by
line in parallel. A first pass finds for each range in which state it ends, and how many rows it finishes, if it
is entered between rows or inside a cell; composed in file order on the driver, a few numbers per range, this gives each its true state. The second pass
cuts rows, and rows that reach over the end of a range are put together by their number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_split import comparable, fixed_ranges, stored

Range = tuple[str, int]


def ends_quoted(line: bytes, quoted: bool, separator: bytes = b",") -> bool:
    """Whether a line ends inside a quoted cell, entered inside one or at the beginning of a row.

    Only a cell that begins with a quote is quoted; in it, two quotes are one. Quotes elsewhere are text.
    """
    if b'"' not in line:
        return quoted
    at, begins = 0, True
    while True:
        if quoted:
            at = line.find(b'"', at) + 1
            if not at:
                return True
            if line[at : at + 1] == b'"':
                at += 1
                continue
            quoted, begins = False, False
        elif begins and line[at : at + 1] == b'"':
            quoted, at = True, at + 1
        else:
            at = line.find(separator, at) + 1
            if not at:
                return False
            begins = True


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    texts = spark.read.option("lineSep", "\n").text(files)
    return texts.select(
        comparable(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, bytes]]:
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()), batch.column("value").to_pylist())


def _effects(separator: bytes):
    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Range, list[list]] = {}  # state and rows finished, by the state at entry
        for name, line in _by_range(batches):
            for way in found.setdefault(name, [[False, 0], [True, 0]]):
                way[0] = ends_quoted(line, way[0], separator)
                way[1] += not way[0]
        rows = [(*name, *outside, *inside) for name, (outside, inside) in found.items()]
        kinds = {"file": pa.string(), "block": pa.int64(), "quoted_0": pa.bool_(), "rows_0": pa.int64(), "quoted_1": pa.bool_(), "rows_1": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return effects


def _cut(states: dict[Range, tuple[bool, int]], separator: bytes):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, bytes, bool]] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = {"file": pa.string(), "block": pa.int64(), "number": pa.int64(), "text": pa.binary(), "whole": pa.bool_()}
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        here, quoted, number, held, whole = None, False, 0, [], True
        for name, line in _by_range(batches):
            if name != here:
                if held:
                    rows.append((*here, number, b"\n".join(held) + b"\n", False))
                here, held = name, []
                quoted, number = states[name]
                whole = not quoted
            held.append(line)
            quoted = ends_quoted(line, quoted, separator)
            if not quoted:
                text = b"\n".join(held)
                rows.append((*name, number, text, whole))
                size += len(text)
                held, number, whole = [], number + 1, True
                if size > 1 << 22 or len(rows) >= 20_000:
                    yield out()
                    rows, size = [], 0
        if held:
            rows.append((*here, number, b"\n".join(held) + b"\n", False))
        if rows:
            yield out()

    return cut


def split_rows(spark: SparkSession, files: list[str], separator: str = ",", range_bytes: int | None = None) -> DataFrame:
    """``file, number, value``: the text of every row, the header (number 0) included; blank lines are left out. Stored."""
    with fixed_ranges(spark, range_bytes):
        sign = separator.encode()
        found = _lines(spark, files).mapInArrow(
            _effects(sign), "file string, block long, quoted_0 boolean, rows_0 long, quoted_1 boolean, rows_1 long"
        )
        ranges = defaultdict(list)
        for r in found.collect():  # one row per range
            ranges[r["file"]].append(r)
        states: dict[Range, tuple[bool, int]] = {}
        for file, parts in ranges.items():
            quoted, number = False, 0
            for r in sorted(parts, key=lambda r: r["block"]):
                states[file, r["block"]] = quoted, number
                number += r["rows_1"] if quoted else r["rows_0"]
                quoted = r["quoted_1"] if quoted else r["quoted_0"]
        cut = stored(
            _lines(spark, files).mapInArrow(_cut(states, sign), "file string, block long, number long, text binary, whole boolean"),
            "rows",
        )
    # a row has one part in each range that it touches
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = (
        cut.filter("not whole")
        .groupBy("file", "number")
        .agg(F.array_join(F.transform(parts, lambda p: p["text"].cast("string")), "").alias("value"))
    )
    whole = cut.filter("whole").select("file", "number", F.col("text").cast("string").alias("value"))
    rows = whole.union(joined).withColumn("value", F.regexp_replace("value", r"\r?\n?\z", ""))
    return rows.filter(F.btrim("value", F.lit(" \t\r")) != "")
