"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones a transportation problem is
solved: bytes that stay in their shard cost nothing, moved bytes cost one each (or what a given
cost matrix says), so the solution moves the fewest bytes. The graph has one node per shard; rows
never enter it. Each old shard is laid out as a sequence of blocks (ranges of a row hash), and the
flows cut that sequence into intervals: whole blocks move, only the block a cut falls into is split
between two shards, row by row. ``rewrite`` then writes the shards whose rows change and leaves the
others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import store, text_of

#: Blocks per old shard. Their sizes are all that is collected: shards x blocks numbers.
BLOCKS = 512


def min_cost_flow(
    supply: list[int], capacity: list[int], cost: list[list[int]] | None = None
) -> list[list[int]]:
    """Amounts from each source to each sink, shipping all supply at the least total cost.

    Successive shortest augmenting paths; the default cost is 0 on the diagonal and 1 elsewhere.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities hold less than the shards do")
    sources, sinks = range(len(supply)), range(len(capacity))
    if cost is None:
        cost = [[int(i != j) for j in sinks] for i in sources]
    flow = [[0] * len(capacity) for _ in sources]
    left, room = list(supply), list(capacity)
    while any(left):
        # distances from the sources with supply left, over arcs and reversed used arcs
        near = [0 if left[i] else None for i in sources]
        far: list[int | None] = [None] * len(capacity)
        into: list[int | None] = [None] * len(capacity)
        back: list[int | None] = [None] * len(supply)
        changed = True
        while changed:
            changed = False
            for i in sources:
                if near[i] is None:
                    continue
                for j in sinks:
                    if far[j] is None or near[i] + cost[i][j] < far[j]:
                        far[j], into[j], changed = near[i] + cost[i][j], i, True
            for j in sinks:
                if far[j] is None:
                    continue
                for i in sources:
                    if flow[i][j] and (near[i] is None or far[j] - cost[i][j] < near[i]):
                        near[i], back[i], changed = far[j] - cost[i][j], j, True
        end = min((j for j in sinks if room[j]), key=lambda j: (far[j], j))
        path, j = [], end
        while True:
            i = into[j]
            path.append((i, j, 1))
            if back[i] is None:
                break
            j = back[i]
            path.append((i, j, -1))
        amount = min([left[i], room[end], *(flow[a][b] for a, b, way in path if way < 0)])
        for a, b, way in path:
            flow[a][b] += way * amount
        left[i] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that add up to the total and differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def sized_rows(
    docs: DataFrame, old_shard: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, text_key, row, old_shard, block: what the transfer works on, stored."""
    text = text_of(text_column)
    ident = F.col(id_column).cast("long")
    spot = F.xxhash64(ident, F.crc32(text))
    return store(
        docs.select(
            ident.alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
            old_shard.cast("int").alias("old_shard"),
            F.pmod(spot, F.lit(BLOCKS)).cast("int").alias("block"),
            spot.alias("spot"),
        ),
        "sized",
    )


def _intervals(flow: list[list[int]]) -> list[tuple[int, int, int]]:
    """(old shard, first byte, new shard) of each piece of an old shard; the stay goes first."""
    pieces = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                pieces.append((i, at, j))
                at += row[j]
    return pieces


def transfer(sized: DataFrame, old_shards: int, capacities: list[int] | None, new_shards: int) -> DataFrame:
    """Add ``shard`` to ``sized``; without capacities the new shards are made equal in bytes."""
    blocks = store(
        sized.groupBy("old_shard", "block").agg(F.sum("size").alias("block_size")), "blocks"
    )
    # a few hundred rows per shard at most, so this window is bounded
    spans = blocks.select(
        "old_shard",
        "block",
        F.coalesce(
            F.sum("block_size").over(
                Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("block_from"),
    )
    held = {r["old_shard"]: r["n"] for r in blocks.groupBy("old_shard").agg(F.sum("block_size").alias("n")).collect()}
    supply = [held.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), new_shards))
    # blocks are at most old_shards x BLOCKS rows
    placed = sized.join(F.broadcast(spans), ["old_shard", "block"])
    before = Window.partitionBy("old_shard", "block").orderBy("spot", "doc_id", "row")
    # a row belongs to the piece that holds its middle byte
    middle = (
        F.col("block_from") + F.sum("size").over(before) - F.col("size") + F.floor(F.col("size") / 2)
    )
    shard = F.lit(None).cast("int")
    for i, first, j in _intervals(flow):
        shard = F.when((F.col("old_shard") == i) & (middle >= first), F.lit(j)).otherwise(shard)
    return placed.withColumn("shard", shard).drop("block_from")


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: offsets of blocks, then inside a block."""
    placed = store(placed, "placed")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "shard",
        "block",
        F.coalesce(
            F.sum("n").over(
                Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("slot_from"),
    )
    inside = Window.partitionBy("shard", "block").orderBy("spot", "doc_id", "row")
    return placed.join(F.broadcast(offsets), ["shard", "block"]).withColumn(
        "slot", F.col("slot_from") + F.row_number().over(inside) - 1
    )


def reshard(
    docs: DataFrame,
    old_shard: Column,
    old_shards: int,
    new_shards: int,
    capacities: list[int] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, text_key (MD5), old_shard, shard, slot for every row.

    ``old_shard`` gives numbers from 0 to ``old_shards - 1``. A null text has size 1 and the
    checksum of the empty text; null ids and repeated rows are placed like others, each with a slot
    of its own; an empty table gives no rows. Shards differ from their capacity by a few rows per
    piece at most. Only the named columns are read.
    """
    sized = sized_rows(docs, old_shard, id_column, text_column)
    return with_slots(transfer(sized, old_shards, capacities, new_shards)).select(
        "doc_id", "size", "text_crc32", "text_key", "old_shard", "shard", "slot"
    )


def _row_key(ident: Column, text_key: Column) -> Column:
    """One name for an id, also a missing one, with its text."""
    return F.md5(F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("none")), text_key))


def _copies(rows: DataFrame, key: str, part: Column, order: str) -> DataFrame:
    """Add ``_copy``: the number of a row among those with its key, counted part by part so that no key is one task's."""
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(key, "_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(key, "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(key, "_part").orderBy(order)
    numbered = rows.withColumn("_inside", F.row_number().over(inside)).join(ahead, [key, "_part"])
    return numbered.withColumn("_copy", F.col("_ahead") + F.col("_inside")).drop("_part", "_inside", "_ahead")


def rewrite(
    placed: DataFrame, docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text"
) -> list[int]:
    """Write the shards that lose or gain rows below ``folder`` (``shard=N``); give their numbers.

    A row is known by its id and its text; of rows that repeat both, any takes the place of any other, so that missing
    and repeated ids are written as often as they were placed. A shard that
    keeps exactly its rows is not written again. A column ``shard`` of ``docs`` is replaced by the new number.
    """
    moved = placed.filter("shard <> old_shard")
    touched = [
        r["shard"]
        for r in moved.select("shard").union(moved.select(F.col("old_shard"))).distinct().collect()
    ]
    key = _row_key(F.col(id_column).cast("long"), F.md5(text_of(text_column))).alias("_key")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    rows = store(docs.select(*kept, key, F.monotonically_increasing_id().alias("_place")), "rewritten")
    spots = placed.select(
        _row_key(F.col("doc_id"), F.col("text_key")).alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")
    )
    # a stretch of slots is a part of bounded size
    stretch = F.col("_shard").cast("long") * F.lit(1 << 32) + F.floor(F.col("_slot") / 100_000)
    spots = _copies(spots, "_key", stretch, "_slot").filter(F.col("_shard").isin(touched))
    places = _copies(rows.select("_key", "_place"), "_key", F.shiftright("_place", 33), "_place")
    chosen = places.join(spots, ["_key", "_copy"]).select("_place", "_shard", "_slot")
    (
        rows.join(chosen, "_place")
        .drop("_key", "_place")
        .withColumnRenamed("_shard", "shard")
        .repartition("shard", F.floor(F.col("_slot") / 100_000))
        .sortWithinPartitions("shard", "_slot")
        .drop("_slot")
        .write.partitionBy("shard")
        .parquet(folder)
    )
    return sorted(touched)
