"""Large JSON documents read by many tasks.

Spark's text reader cuts a file at commas, so that byte ranges are read in parallel from any storage. Whether
a comma separates elements depends on all text before it, in two ways: is it inside a string, and how deep
is it. A first pass finds, for each range, what it does to both, for either state of the first. These are a few
numbers per range; composed in file order on the driver they give every range its true state at entry. The next passes
cut at separators. Pieces that reach over range ends are put together by their number.

Two shapes are cut: an array into its elements, and an object into its members, where members that hold an
array may be cut into its elements as well. Every piece is checked, so a document is accepted exactly if the whole is valid.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import variants as V
from ..session import scratch_dir
from . import jsonl

_STEPS = np.zeros(256, np.int64)
_STEPS[[ord("["), ord("{")]] = 1
_STEPS[[ord("]"), ord("}")]] = -1
#: The key of a member; the brace before it belongs to the root.
_KEY = re.compile(rb'[\s{]*("(?:[^"\\]|\\.)*")\s*:')
_ARRAY_MEMBER = r'^[ \t\n\r]*"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t\n\r]*:[ \t\n\r]*\['
_SPACES = " \t\n\r"

Range = tuple[str, int]


@dataclass(frozen=True)
class State:
    """What is known where a range begins."""

    in_string: bool = False
    depth: int = 0
    #: whether the container below the root that is open, if one is, is an array
    in_array: bool = False
    #: pieces finished before, number of the piece that began the member, and whether it has the wanted key
    pieces: int = 0
    member: int = 0
    wanted: bool = False


def comparable(uri: Column) -> Column:
    """Local URIs have one slash or three, depending on the reader."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def large_files(spark: SparkSession, paths: list[str], limit: int) -> dict[str, int]:
    """The files above a length, with their lengths; only the listing is read."""
    files = spark.read.format("binaryFile").load(paths).where(F.col("length") > limit)
    return {r["file"]: r["length"] for r in files.select(comparable(F.col("path")).alias("file"), "length").collect()}


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The bytes between the commas of files, in order within each range (file, block)."""
    texts = spark.read.option("lineSep", ",").text(paths)
    return texts.select(
        comparable(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, np.ndarray, np.ndarray]]:
    """Parts of one range each: its name, the bytes of some records with a comma behind each, and the commas' places."""
    for batch in batches:
        files = batch.column("file").dictionary_encode()
        blocks, codes = batch.column("block").to_numpy(), files.indices.to_numpy()
        cuts = (np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)]):
            values = batch.column("value").slice(a, b - a).to_pylist()
            if values:
                ends = np.cumsum([len(v) + 1 for v in values]) - 1
                name = files.dictionary[int(codes[a])].as_py(), int(blocks[a])
                yield name, np.frombuffer(b",".join(values) + b",", np.uint8), ends


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: behind no or an even number of backslashes."""
    quote = data == ord('"')
    slashed = np.flatnonzero(quote[1:] & (data[:-1] == ord("\\"))) + 1
    if len(slashed):
        other = np.maximum.accumulate(np.where(data != ord("\\"), np.arange(len(data)), -1))
        quote[slashed[(slashed - 1 - other[slashed - 1]) % 2 == 1]] = False
    return quote


_EFFECTS = "file string, block long, odd long, outside long, inside long, size long, root long"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: is its number of quotes odd, how much deeper it ends if entered outside or inside a string, its size, its first character."""
    found: dict[Range, list[int]] = {}
    for name, data, _ in _runs(batches):
        odd, outside, inside, size, root = found.get(name, [0, 0, 0, 0, 0])
        quote = _quotes(data)
        in_string = ((np.cumsum(quote) + odd) & 1).astype(bool)
        steps = _STEPS[data]
        first = data[~np.isin(data, [32, 9, 10, 13])][:1]
        found[name] = [
            (odd + int(quote.sum())) & 1,
            outside + int(steps[~in_string].sum()),
            inside + int(steps[in_string].sum()),
            size + len(data),
            root or int(first[0]) if len(first) else root,
        ]
    values = np.array(list(found.values()), np.int64).reshape(-1, 5)
    columns = [pa.array([f for f, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64())]
    columns += [pa.array(values[:, k]) for k in range(5)]
    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "odd", "outside", "inside", "size", "root"])


@dataclass
class Piece:
    """A piece, or as much of it as one range has."""

    number: int
    text: bytes
    starts_here: bool
    ends_here: bool
    from_depth: int | None = None
    to_depth: int | None = None
    member: int | None = None
    wanted: bool | None = None


class _Walk:
    """Goes through the records of one range and cuts at separators: commas of the root, and with ``inner`` of arrays in it."""

    def __init__(self, state: State, first: bool, inner: bool, key: str | None):
        self.state, self.inner, self.key = state, inner, key
        self.held: list[bytes] = []
        separator = not state.in_string and (state.depth == 1 or (inner and state.depth == 2 and state.in_array))
        self.fresh = first or separator  # a piece begins here
        self.begun: tuple[int, int, bool] | None = None

    def _begin(self, text: bytes) -> None:
        depth = max(self.state.depth, 1)
        if depth == 1:
            found, wanted = _KEY.match(text) if self.key is not None else None, False
            if found is not None:
                try:
                    wanted = json.loads(found[1]) == self.key
                except ValueError:
                    wanted = False  # the check of the piece will find it
            self.state = replace(self.state, member=self.state.pieces, wanted=wanted)
        self.begun, self.fresh = (depth, self.state.member, self.state.wanted), False

    def _piece(self, text: bytes, ends_here: bool, to_depth: int | None) -> Piece:
        begun = self.begun or (None, None, None)
        piece = Piece(self.state.pieces, text, self.begun is not None, ends_here, begun[0], to_depth, begun[1], begun[2])
        self.begun = None
        return piece

    def scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which bytes are in strings, the depth behind each, and where containers below the root open."""
        in_string = ((np.cumsum(_quotes(data)) + self.state.in_string) & 1).astype(bool)
        steps = np.where(in_string, 0, _STEPS[data])
        depth = self.state.depth + np.cumsum(steps)
        return in_string, depth, np.flatnonzero((steps == 1) & (depth == 2))

    def feed(self, data: np.ndarray, ends: np.ndarray, scanned: tuple | None = None) -> Iterator[Piece]:
        state = self.state
        in_string, depth, opened = scanned or self.scan(data)
        last = np.searchsorted(opened, ends) - 1
        in_array = np.full(len(ends), state.in_array)
        in_array[last >= 0] = data[opened[last[last >= 0]]] == ord("[")
        cut = ~in_string[ends] & ((depth[ends] == 1) | (self.inner & (depth[ends] == 2) & in_array))
        raw, at = data.tobytes(), 0
        begins = np.concatenate(([0], ends[:-1] + 1))
        if self.fresh:
            self._begin(raw[: int(ends[0])])
        for i in np.flatnonzero(cut).tolist():
            end = int(ends[i])
            yield self._piece(b"".join([*self.held, raw[at:end]]), True, int(depth[end]))
            self.held, at, self.fresh = [], end + 1, True
            self.state = replace(self.state, depth=int(depth[end]), pieces=self.state.pieces + 1)
            if i + 1 < len(ends):
                self._begin(raw[int(begins[i + 1]) : int(ends[i + 1])])
        if at < len(raw):
            self.held.append(raw[at:])
        self.state = replace(
            self.state, in_string=bool(in_string[-1]), depth=int(depth[-1]), in_array=bool(in_array[-1])
        )

    def rest(self) -> Piece | None:
        """What the next range, or the end of the file, goes on with."""
        return self._piece(b"".join(self.held), False, None) if self.held else None


_SUMMARY = "file string, block long, entered_array boolean, pieces long, member long, wanted boolean, in_array boolean"


def _summaries(states: dict[Range, State], inner: bool, key: str | None):
    """For each range and kind of container that it may be entered in: pieces it finishes, last member it begins, kind at its end."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[Range, list[_Walk]] = {}
        for name, data, ends in _runs(batches):
            if name not in states:
                continue  # a file of another shape
            if name not in walks:
                start = replace(states[name], pieces=0, member=-1)
                # without inner cuts the kind of container makes no difference
                walks[name] = [_Walk(replace(start, in_array=x), name[1] == 0, inner, key) for x in ((False, True) if inner else (False,))]
            scanned = walks[name][0].scan(data)  # the walks differ in the kind of container only
            for walk in walks[name]:
                for _ in walk.feed(data, ends, scanned):
                    pass
                walk.held = []
        rows = [(*name, bool(x), w.state.pieces, w.state.member, w.state.wanted, w.state.in_array) for name, pair in walks.items() for x, w in enumerate(pair)]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "entered_array", "pieces", "member", "wanted", "in_array"])

    return summarise


_PIECES = (
    "file string, block long, number long, text binary, whole boolean, from_depth int, to_depth int, member long, wanted boolean"
)


def _pieces(states: dict[Range, State], inner: bool, key: str | None):
    def rows(name: Range, pieces: list[Piece]) -> pa.RecordBatch:
        def column(kind, values):
            return pa.array(values, kind)

        return pa.RecordBatch.from_arrays(
            [
                column(pa.string(), [name[0]] * len(pieces)),
                column(pa.int64(), [name[1]] * len(pieces)),
                column(pa.int64(), [p.number for p in pieces]),
                column(pa.binary(), [p.text for p in pieces]),
                column(pa.bool_(), [p.starts_here and p.ends_here for p in pieces]),
                column(pa.int32(), [p.from_depth for p in pieces]),
                column(pa.int32(), [p.to_depth for p in pieces]),
                column(pa.int64(), [p.member for p in pieces]),
                column(pa.bool_(), [p.wanted for p in pieces]),
            ],
            names=["file", "block", "number", "text", "whole", "from_depth", "to_depth", "member", "wanted"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, walk = None, None
        for found, data, ends in _runs(batches):
            if found not in states:
                continue
            if found != name:
                if walk is not None and (last := walk.rest()):
                    yield rows(name, [last])
                name, walk = found, _Walk(states[found], found[1] == 0, inner, key)
            pieces = list(walk.feed(data, ends))
            if pieces:
                yield rows(name, pieces)
        if walk is not None and (last := walk.rest()):
            yield rows(name, [last])

    return cut


@dataclass
class Layout:
    """Large files: their root characters, the state at each range, and whether strings and brackets are closed at the end."""

    files: list[str]
    roots: dict[str, str]
    states: dict[Range, State]
    closed: dict[str, bool]


def layout(spark: SparkSession, lengths: dict[str, int]) -> Layout:
    """The first pass over files, given by path with their length in bytes."""
    ranges = defaultdict(list)
    for r in _records(spark, list(lengths)).mapInArrow(_effects, _EFFECTS).collect():  # one row per range
        ranges[r["file"]].append(r)
    found = Layout(list(lengths), {}, {}, {})
    for file, rows in ranges.items():
        in_string, depth, size = False, 0, 0
        for r in sorted(rows, key=lambda r: r["block"]):
            found.states[file, r["block"]] = State(in_string, depth)
            if r["block"] == 0:
                found.roots[file] = chr(r["root"])
            depth += r["inside"] if in_string else r["outside"]
            in_string ^= bool(r["odd"])
            size += r["size"]
        # every record counts with a comma, so a comma at the very end is one too few
        found.closed[file] = not in_string and depth == 0 and size == lengths[file] + 1
    return found


def pieces_of(spark: SparkSession, files: list[str], known: Layout, inner: bool, key: str | None) -> DataFrame:
    """file, number, from_depth, to_depth (NULL for the last), member, wanted, text of every piece of the given files.

    Every pass reads all known files, since how they are cut into ranges depends on all of them.

    ``inner`` cuts arrays below the root, too; ``wanted`` says that the piece belongs to a member named ``key``.
    """
    states = {name: state for name, state in known.states.items() if name[0] in set(files)}
    by_range = {
        (r["file"], r["block"], r["entered_array"]): r
        for r in _records(spark, known.files).mapInArrow(_summaries(states, inner, key), _SUMMARY).collect()
    }
    file = None
    for name in sorted(states):
        if name[0] != file:
            file, pieces, member, wanted, in_array = name[0], 0, 0, False, False
        states[name] = replace(states[name], pieces=pieces, member=member, wanted=wanted, in_array=in_array)
        r = by_range[*name, in_array]
        if r["member"] >= 0:
            member, wanted = pieces + r["member"], r["wanted"]
        pieces, in_array = pieces + r["pieces"], inner and r["in_array"]
    # stored, since whole pieces and parts are two reads of it
    found = stored(_records(spark, known.files).mapInArrow(_pieces(states, inner, key), _PIECES), "pieces")
    # at most two parts of pieces per range
    parts = found.filter("not whole").groupBy("file", "number").agg(
        F.max("from_depth").alias("from_depth"),
        F.max("to_depth").alias("to_depth"),
        F.max("member").alias("member"),
        F.max("wanted").alias("wanted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"].cast("string")), "").alias("text"),
    )
    columns = ("file", "number", "from_depth", "to_depth", "member", "wanted", "text")
    last = F.col("to_depth").isNull()
    # the comma behind the last record is not in the file
    ended = parts.withColumn("text", F.when(last, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    whole = found.filter("whole").withColumn("text", F.col("text").cast("string"))
    return whole.select(*columns).union(ended.select(*columns))


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _bare(pieces: DataFrame, opening: str, closing: str) -> DataFrame:
    """Pieces without the root's brackets; ``framed`` tells whether these are where they must be."""
    first, last, text = F.col("number") == 0, F.col("to_depth").isNull(), F.col("text")
    left = F.when(first, F.expr("substr(text, 2)")).otherwise(text)
    right = F.when(last, F.expr("left(text, length(text) - 1)")).otherwise(text)
    return (
        pieces.withColumn("text", _trimmed(text))
        .withColumn("framed", (~first | F.startswith("text", F.lit(opening))) & (~last | (F.endswith("text", F.lit(closing)) & (~first | (F.length("text") > 1)))))
        .withColumn("text", left)
        .withColumn("text", right)
        .withColumn("text", _trimmed(F.col("text")))
        .withColumn("alone", first & last)
        .withColumn("to_depth", F.coalesce("to_depth", F.lit(1)))
    )


def array_elements(spark: SparkSession, files: list[str], known: Layout) -> DataFrame:
    """file, pos, raw, ok for each element of root arrays; an empty array has one row without ``raw``."""
    bare = _bare(pieces_of(spark, files, known, False, None), "[", "]")
    empty = F.col("alone") & (F.col("text") == "")
    return bare.select(
        "file",
        F.col("number").alias("pos"),
        F.when(~empty, F.col("text")).alias("raw"),
        (F.col("framed") & (empty | V.is_json(F.col("text")))).alias("ok"),
    )


def object_pieces(spark: SparkSession, files: list[str], known: Layout, inner: bool, key: str | None) -> DataFrame:
    """file, number, member, wanted, form, raw, ok for each piece of root objects.

    ``form`` is ``member`` (``raw`` is an object with this member alone), ``element`` of a member's array, or
    ``empty`` for the one piece of an empty object.
    """
    bare = _bare(pieces_of(spark, files, known, inner, key), "{", "}")
    text, empty = F.col("text"), F.col("alone") & (F.col("text") == "")
    begins, ends = F.col("from_depth") == 1, F.col("to_depth") == 1
    member = F.concat(F.lit("{"), text, F.lit("}"))
    inside = _trimmed(F.regexp_replace(text, _ARRAY_MEMBER, ""))
    closing = F.endswith(text, F.lit("]"))
    element = F.when(begins, inside).when(ends, _trimmed(F.expr("left(text, length(text) - 1)"))).otherwise(text)
    right = (
        F.when(begins & ends, text != "").when(begins, text.rlike(_ARRAY_MEMBER)).when(ends, closing).otherwise(F.lit(True))
    )
    form = F.when(empty, "empty").when(begins & ends, "member").otherwise("element")
    return bare.select(
        "file", "number", "member", "wanted", form.alias("form"),
        F.when(form == "member", member).when(form == "element", element).alias("raw"),
        "framed", right.alias("right"),
    ).select(
        "file", "number", "member", "wanted", "form", "raw",
        (F.col("framed") & F.when(F.col("form") == "empty", True).otherwise(
            V.is_json(F.col("raw")) & F.col("right")
        )).alias("ok"),
    )


@contextmanager
def fixed_ranges(spark: SparkSession, range_bytes: int | None = None) -> Iterator[None]:
    """Ranges that do not depend on how many executors there are at the moment; of a given size, if there is one."""
    wanted = {"spark.sql.files.minPartitionNum": spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)}
    if range_bytes is not None:
        wanted["spark.sql.files.maxPartitionBytes"] = str(range_bytes)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _broken(pieces: DataFrame, files: list[str], known: Layout) -> set[str]:
    """The files that are not valid JSON."""
    found = pieces.filter(~F.col("ok")).select("file").distinct().collect()  # large files only
    return {r["file"] for r in found} | {f for f in files if not known.closed[f]}


ITEMS = "seq struct<source_file:string,pos:bigint>, source_file string, item variant, raw string, error string"


def _failed(spark: SparkSession, errors: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(errors.items()), "file string, error string")
    return _items(rows.select("file", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), "error"))


def _items(rows: DataFrame) -> DataFrame:
    source = P.plain_path(F.col("file"))
    item = F.try_parse_json("text")
    return rows.select(
        F.struct(source.alias("source_file"), "pos").alias("seq"),
        source.alias("source_file"),
        item.alias("item"),
        F.when(V.kind(item).isin("object", "array"), F.col("text")).alias("raw"),
        "error",
    )


def large_items(
    spark: SparkSession, lengths: dict[str, int], json_key: str | None = None, range_bytes: int | None = None
) -> tuple[DataFrame | None, list[str]]:
    """The items of large documents as in ``jsonl.json_items``, and the files that cannot be cut.

    A root array is cut into its elements; with ``json_key`` a root object is, too, and an array under that key.
    A single object or scalar without a key is one item and has to be parsed as a whole. The pieces are stored once.
    """
    with fixed_ranges(spark, range_bytes):
        return _large_items(spark, lengths, json_key)


def _large_items(spark: SparkSession, lengths: dict[str, int], json_key: str | None) -> tuple[DataFrame | None, list[str]]:
    known = layout(spark, lengths)
    arrays = [f for f, c in known.roots.items() if c == "["]
    objects = [f for f, c in known.roots.items() if c == "{"] if json_key is not None else []
    found, errors = [], {}
    if arrays:
        pieces = stored(array_elements(spark, arrays, known), "elements")
        bad = _broken(pieces, arrays, known)
        good = [f for f in arrays if f not in bad]
        errors |= dict.fromkeys(bad, "JSON decode error")
        if json_key is not None:
            errors |= dict.fromkeys(good, f"Key '{json_key}' not found in JSON")
        else:
            rows = pieces.filter(F.col("file").isin(good) & F.col("raw").isNotNull())
            found.append(_items(rows.select("file", "pos", F.col("raw").alias("text"), F.lit(None).cast("string").alias("error"))))
    if objects:
        pieces = stored(object_pieces(spark, objects, known, True, json_key), "members")
        bad = _broken(pieces, objects, known)
        last = pieces.filter("wanted").groupBy("file").agg(F.max("member").alias("of")).collect()  # a repeated key: the last
        members = {r["file"]: r["of"] for r in last if r["file"] not in bad}
        errors |= dict.fromkeys(bad, "JSON decode error")
        errors |= {f: f"Key '{json_key}' not found in JSON" for f in objects if f not in bad and f not in members}
        chosen = spark.createDataFrame(list(members.items()), "file string, member long")  # one row per large file
        rows = stored(pieces.join(F.broadcast(chosen), ["file", "member"]).filter(F.col("wanted")), "wanted")
        text = F.col("raw").alias("text")
        elements = rows.filter("form = 'element'").select("file", (F.col("number") - F.col("member")).alias("pos"), text, F.lit(None).cast("string").alias("error"))
        single = jsonl.json_items(rows.filter("form = 'member'").select(P.plain_path(F.col("file")).alias("source_file"), F.col("raw").alias("value")), json_key)
        found += [_items(elements), _long_positions(single)]
    if errors:
        found.append(_failed(spark, errors))
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    return out, [f for f in lengths if f not in arrays and f not in objects]


def _long_positions(items: DataFrame) -> DataFrame:
    return items.withColumn("seq", F.col("seq").cast("struct<source_file:string,pos:bigint>"))


def large_members(spark: SparkSession, lengths: dict[str, int]) -> DataFrame:
    """file, number, value: each member of large root objects as an object of its own; other or broken documents give none."""
    with fixed_ranges(spark):
        known = layout(spark, lengths)
        objects = [f for f, c in known.roots.items() if c == "{"]
        if not objects:
            return spark.createDataFrame([], "file string, number long, value string")
        pieces = stored(object_pieces(spark, objects, known, False, None), "members")
    good = [f for f in objects if f not in _broken(pieces, objects, known)]
    return pieces.filter(F.col("file").isin(good) & (F.col("form") == "member")).select("file", "number", F.col("raw").alias("value"))
