"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidates.

A text is the set of its distinct five-word shingles, hashed to 64 bits. One permutation hashing cuts the hash
range into bins and keeps the least hash of each; an empty bin copies the first filled one of a
fixed random probe order of its own (optimal densification). Rows of bins form bands, equal bands
form buckets. A bucket proposes a star instead of all pairs: every member against one hub, the
member that shares the most buckets. Every proposal is confirmed on the full sets. A bucket whose
other members still lie in several components stays open. From then on the parity bits of two sets rule
out most pairs: bits that differ are shingles that only one of both has. Where the pairs that reach over
components are few for each member, all of them are proposed at once. Else open buckets propose stars around
several times as many further hubs from round to round, so no link is lost to the choice of a hub; before
that, members are left out whose shingles are too seldom shared for any link. Equal sets are
collapsed first; copies never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store, store_counted, string_column, text_of, text_slices, utf8_buffer

WORDS = 5
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Bits of the filter that picks the texts of the second scan: 8 MB at any size of the input.
FILTER_BITS = 1 << 26
CHUNK_BITS = 1 << 15

#: Parity bits of a set.
SKETCH_BITS = 256

#: So many pairs over components for each member of the open buckets are proposed at once.
CROSSING_EACH = 1024
#: Else by how much the number of hubs of an open bucket grows from round to round.
HUB_GROWTH = 8

_random = np.random.default_rng(20250901)
MULTIPLIERS = _random.integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
ROW_MULTIPLIERS = _random.integers(1 << 62, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
BAND_OFFSETS = _random.integers(1 << 62, 1 << 63, BANDS, dtype=np.uint64)
#: For each bin the order in which it looks for a filled one.
PROBES = np.argsort(_random.random((BINS, BINS)), axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the n + 1 bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    raw, bounds = utf8_buffer(coded.dictionary)
    data = raw.tobytes()
    ends = bounds.tolist()
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(ends) - 1
    )
    filled = np.diff(bounds) > 0  # splitting leaves an empty word where white space begins or ends a text
    keep = filled[codes]
    counts = np.concatenate(([0], np.cumsum(keep)))
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return hashes[codes[keep]], counts[offsets]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are one shingle."""
    words, bounds = word_hashes(texts)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * MULTIPLIERS[k]
        rolled = _mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            sets.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = (words[a:b] * MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(_mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` least hashes per non-empty set."""
    found = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, values in enumerate(sets):
        bins = ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # ascending, as the values are
        first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
        at = bins[first].astype(np.int64)
        found[i, at] = values[first]
        filled[i, at] = True
    row, bin_ = np.nonzero(~filled)
    for turn in range(BINS):
        if not len(row):
            break
        probe = PROBES[bin_, turn]
        hit = filled[row, probe]
        found[row[hit], bin_[hit]] = found[row[hit], probe[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and band; keys of different bands differ."""
    grouped = found.reshape(len(found), BANDS, ROWS)
    return _mix(_mix((grouped * ROW_MULTIPLIERS).sum(2, dtype=np.uint64)) + BAND_OFFSETS)


def sketch(values: np.ndarray) -> np.ndarray:
    """For each value of the last bits of a set's hashes, whether an odd number of them ends so, as 64-bit numbers."""
    odd = np.bincount((values & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(string_column(batch, "text")):
            part = batch.slice(start, len(texts))
            sets = shingle_sets(texts)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)).view(np.int64) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    part.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "text_key", "n_shingles", "set_key", "bands", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(string_column(batch, "text")):
            part = batch.slice(start, len(texts))
            sets = [s.view(np.int64) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("text_key"), pa.array(sets, pa.list_(pa.int64()))], names=["text_key", "shingles"]
            )


def text_key_of(text_column: str = "text") -> F.Column:
    """The hash under which a text is known."""
    return F.unhex(F.md5(text_of(text_column)))


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, row (unique), text_key, n_shingles, set_key, bands, sketch of every row, stored."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_column).alias("text"),
    ).select("doc_id", "row", text_key_of().alias("text_key"), "text")
    return store(
        rows.mapInArrow(
            _fingerprints,
            "doc_id long, row long, text_key binary, n_shingles long, set_key binary, bands array<long>, sketch array<long>",
        ),
        "fingerprints",
    )


def _picked_sets(docs: DataFrame, text_column: str, wanted: DataFrame) -> DataFrame:
    """node, shingles for the texts named in ``wanted`` (node, text_key), stored.

    A bitmap of fixed size keeps most other texts out of the shuffle; the join decides.
    """

    def bit(key: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))

    bitmap = (
        wanted.select(bit(F.col("text_key")).alias("bit"))
        .groupBy(F.floor(F.col("bit") / CHUNK_BITS).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(CHUNK_BITS))).alias("bits"))
    )
    place = F.pmod("bit", F.lit(CHUNK_BITS))
    # byte of the chunk, then bit of the byte
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    texts = (
        docs.select(F.col(text_column).alias("text"))
        .select(text_key_of().alias("text_key"), "text")
        .withColumn("bit", bit(F.col("text_key")))
        .withColumn("chunk", F.floor(F.col("bit") / CHUNK_BITS))
        .join(F.broadcast(bitmap), "chunk")  # at most FILTER_BITS / CHUNK_BITS rows of 4 kB
        .filter(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0)
        .select("text_key", "text")
    )
    sets = texts.mapInArrow(_full_sets, "text_key binary, shingles array<long>")
    # copies of a text have the same set, any of them will do
    return store(
        sets.join(wanted, "text_key").groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets"
    )


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles both sides: in loops, relations built by the driver would pile up there."""
    return left.join(right.hint("merge"), on, how)


def star_components(edges: DataFrame) -> DataFrame:
    """(root, node) for every node with an edge that is not a root itself; roots are the least nodes.

    ``edges`` has ``a < b``. Alternates the large star (neighbours above a node go to its least
    neighbour) and the small star (neighbours below it do) until nothing moves. Every edge stays one row. A job makes two
    turns of two shuffles each and counts the edges that moved in the second.
    """
    held = None
    while True:
        for _ in range(2):
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = F.least(F.min("b").over(Window.partitionBy("a")), "a")
            large = both.withColumn("m", least).filter("b > a").select(F.col("m").alias("a"), "b", F.expr("m < a").alias("moved"))
            low = large.withColumn("m", F.min("a").over(Window.partitionBy("b")))
            # the least neighbour below keeps the node, the others become its neighbours
            edges = low.select(F.col("m").alias("a"), F.expr("if(a = m, b, a)").alias("b"), F.expr("moved or m < a").alias("moved"))
        edges, (_, moved) = store_counted(edges, "stars", F.count_if("moved"))
        if held is not None:
            discard(held)
        held = edges
        if not moved:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, similar: whether the full sets of each pair are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    return (
        _join(_join(pairs, a, "a"), b, "b")
        .withColumn("both", both)
        .select("a", "b", (100 * F.col("both") >= percent * union).alias("similar"))
    )


def _open(members: DataFrame, stars: DataFrame) -> tuple[DataFrame, int, int]:
    """The members of buckets that reach over more than one component, stored; their number, and that of ordered pairs over components."""
    rooted = _join(members.drop("root"), stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    bucket = Window.partitionBy("bucket")
    spread = rooted.withColumns({"lo": F.min("root").over(bucket), "hi": F.max("root").over(bucket), "all": F.count("*").over(bucket)})
    own = F.count("*").over(Window.partitionBy("bucket", "root"))
    opened = spread.filter("lo < hi").withColumn("others", F.col("all") - own).select(*MEMBER, "others")
    opened, (n_members, crossing) = store_counted(opened, "open", F.sum("others"))
    return opened, n_members, crossing or 0


def _able(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that may still be similar to another one, with ``reach`` counted anew.

    ``reach`` is the number of a set's shingles that any other set among the members has. Two sets
    of sizes n and m need percent / (100 + percent) * (n + m) common ones, so a member whose reach
    is too small for even the smallest set of its bucket has no partner left there. This is exact.
    """
    shingles = _join(sets, members.select("node").distinct(), "node", "left_semi").select(
        "node", F.explode("shingles").alias("shingle")
    )
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1").select("shingle")
    reach = _join(shingles, shared, "shingle").groupBy("node").agg(F.count("*").alias("reach"))
    least = members.groupBy("bucket").agg(F.min("n").alias("least_n"))
    return (
        _join(_join(members.drop("reach"), reach, "node"), least, "bucket")
        .filter(
            (100 * F.col("reach") >= percent * F.col("n"))
            & ((100 + percent) * F.col("reach") >= percent * (F.col("n") + F.col("least_n")))
        )
        .select(*MEMBER)
    )


MEMBER = ("bucket", "node", "n", "score", "root", "reach")


def _possible(percent: int) -> F.Column:
    """Whether a member and a hub may be similar, by what both may have in common and by the bits of both sketches that differ.

    Two sets of sizes n and m that are similar differ in (100 - percent) / (100 + percent) * (n + m) shingles at most, and
    each of these turns one parity bit. This is exact.
    """
    both = F.col("n") + F.col("hub_n")
    differ = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("hub_sketch")[i])) for i in range(SKETCH_BITS // 64))
    return (
        (F.col("root") != F.col("hub_root"))
        & ((100 + percent) * F.least("reach", "hub_reach") >= percent * both)
        & ((100 + percent) * differ <= (100 - percent) * both)
    )


def _as_hubs(members: DataFrame) -> DataFrame:
    return members.select("bucket", *(F.col(c).alias(f"hub_{c}") for c in ("node", "n", "root", "reach", "sketch")))


def _pair() -> list[F.Column]:
    return [F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")]


def links(members: DataFrame, n_members: int, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(root, node) of all components of nodes that share buckets and are similar enough.

    ``members`` (stored, ``n_members`` rows): bucket, node, n (set size), score (how many bucket mates it has), root (its
    component), reach (how many of its shingles another set may have), hub_node and hub_n (of the bucket).
    ``sketches``: node, sketch.
    """
    if not n_members:
        return None
    rest = members.filter("node != hub_node")
    alike = (100 + percent) * F.least("n", "hub_n") >= percent * (F.col("n") + F.col("hub_n"))
    tested = store(_compared(rest.filter(alike).select(*_pair()).distinct(), sets, percent), "pairs")
    stars = star_components(tested.filter("similar").select("a", "b"))
    # what a hub was compared with is settled; a bucket is done when the rest hangs together
    opened, n_members, crossing = _open(rest.select(*MEMBER), stars)
    discard(members)
    hubs_each = 1
    while n_members:
        last = crossing <= CROSSING_EACH * n_members
        if last:
            sketched = _join(opened, sketches, "node")
            pairs = _join(sketched, _as_hubs(sketched), "bucket").filter((F.col("node") < F.col("hub_node")) & _possible(percent))
            pairs = pairs.select(*_pair()).distinct()
        else:
            hubs_each *= HUB_GROWTH
            members = store(_able(opened, sets, percent), "able")
            hubs = store(
                members.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(hubs_each)).alias("salt"))
                .agg(F.max(F.struct("score", "node")).alias("h"))
                .select("bucket", F.col("h.node").alias("node")),
                "hubs",
            )
            sketched = _join(members, sketches, "node")
            # the best members lead in many buckets: a pair is proposed in the first where it could be
            led = hubs.groupBy("node").agg(F.collect_set("bucket").alias("led"))
            inside = members.groupBy("node").agg(F.collect_set("bucket").alias("inside"))  # BANDS at most
            asking = _join(_as_hubs(_join(sketched, hubs, ["bucket", "node"], "left_semi")), led.withColumnRenamed("node", "hub_node"), "hub_node")
            once = F.array_min(F.array_intersect("inside", "led")) == F.col("bucket")
            pairs = (
                _join(_join(sketched, inside, "node"), asking, "bucket")
                .filter((F.col("node") != F.col("hub_node")) & _possible(percent) & once)
                .select(*_pair())
                .distinct()
            )
            pairs = _join(pairs, tested.select("a", "b"), ["a", "b"], "left_anti")
        compared = store(_compared(pairs, sets, percent), "pairs")
        found = compared.filter("similar").select("a", "b")
        stars = star_components(found.union(stars.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        if last:
            discard(opened)
            break
        tested = tested.union(compared)
        rest = _join(members, hubs, ["bucket", "node"], "left_anti")
        before = (opened, members, hubs)
        opened, n_members, crossing = _open(rest, stars)
        discard(*before)
    return stars


def near_duplicates(
    docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; see ``verdicts``."""
    return verdicts(docs, percent, id_column, text_column).drop("text_key")


def verdicts(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_key (see ``text_key_of``), n_shingles, component_id, kept for every row.

    Texts are linked when 100 times the common shingles are at least ``percent`` times all of both;
    ``component_id`` is the smallest id reachable over links. A null or wordless text has no
    shingles and stays alone. Rows that repeat an id and a text get the same answer. Rows without id
    take part and get the id of their component, or null. An empty table gives no rows. Only the two
    named columns are read.
    """
    prints = fingerprints(docs, id_column, text_column)
    classes = store(
        prints.filter("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("least_id"),
            F.min("text_key").alias("text_key"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
        ),
        "classes",
    )
    bucket = Window.partitionBy("bucket")
    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.withColumn("mates", F.count("*").over(bucket)).filter("mates > 1")
    scored = shared.withColumn("score", F.sum("mates").over(Window.partitionBy("node")))
    hub = F.max(F.struct("score", "node", "n")).over(bucket)
    members, (n_members,) = store_counted(
        scored.withColumn("hub", hub).select(
            "bucket", "node", "n", "score", F.col("node").alias("root"), F.col("n").alias("reach"),
            F.col("hub.node").alias("hub_node"), F.col("hub.n").alias("hub_n"),
        ),
        "members",
    )
    wanted = store(classes.select("node", "text_key").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = _picked_sets(docs, text_column, wanted)
    stars = links(members, n_members, classes.select("node", "sketch"), sets, percent)
    discard(wanted, sets)
    if stars is None:
        labels = classes.select("set_key", F.col("least_id").alias("component_id"))
    else:
        rooted = classes.select("set_key", "node", "least_id").join(stars, "node", "left").withColumn(
            "root", F.coalesce("root", "node")
        )
        least = F.min("least_id").over(Window.partitionBy("root"))
        labels = rooted.withColumn("component_id", least).select("set_key", "component_id")
    # a class of copies may hold much of the table; adaptive execution splits its rows
    return (
        prints.select("doc_id", "text_key", "n_shingles", "set_key")
        .join(labels, "set_key", "left")
        .select(
            "doc_id",
            "text_key",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
