"""Exact deduplication through a cuckoo-filter index of live digests.

The index is a table with one row per live digest, split by hash into buckets of a few thousand
digests. Inside a bucket a cuckoo filter answers whether a digest may be live. A miss is new
without any look at the contents; a hit is verified against the bucket's stored SHA-256 digests, so
false positives of the filter never merge different texts. A filter that overflows is doubled and
refilled from the stored digests. Deleting the last live row of a digest frees its slot.

Rows meet twice: every input task first combines its own repeats with the same structure, so a
text that makes up a third of the table reaches its bucket as one row per task, and only then are
the buckets formed. Texts never leave the scan; what moves is 32 bytes of digest per distinct text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Expected digests per bucket of the index; decides the number of buckets of a new one.
DIGESTS_PER_BUCKET = 4096
#: Distinct digests one input task combines before it passes them on.
COMBINED_AT_ONCE = 1 << 18
SLOTS = 4
MAX_KICKS = 64

ENTRY = "sha binary, live long, keep_len long, keep_id long, keep_row long"
ENTRY_SCHEMA = pa.schema(
    [
        ("sha", pa.binary()),
        ("live", pa.int64()),
        ("keep_len", pa.int64()),
        ("keep_id", pa.int64()),
        ("keep_row", pa.int64()),
    ]
)


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; a key has two possible buckets."""

    def __init__(self, expected: int):
        buckets = 8
        while buckets * SLOTS * 0.9 < expected:
            buckets *= 2
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.mask = np.uint64(buckets - 1)

    @property
    def capacity(self) -> int:
        return self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((keys >> np.uint64(16)) & self.mask).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        # an odd multiplier, so the step depends on every bit of the fingerprint
        step = (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & self.mask
        return bucket ^ step.astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def insert(self, keys: np.ndarray, stored) -> None:
        """Add distinct keys; on overflow double the table and refill it from ``stored()``.

        ``stored()`` gives every live key, the new ones included.
        """
        if not self._try_insert(keys):
            buckets = len(self.table)
            everything = stored()
            while True:
                buckets *= 2
                self._clear(buckets)
                if self._try_insert(everything):
                    return

    def _try_insert(self, keys: np.ndarray) -> bool:
        prints, first, second = self._places(keys)
        left = np.arange(len(keys))
        for places in (first, second) * SLOTS:
            if not len(left):
                return True
            # one key per bucket and pass, so no two claim the same slot
            bucket, pick = np.unique(places[left], return_index=True)
            free = self.table[bucket] == 0
            open_ = free.any(1)
            chosen = left[pick[open_]]
            self.table[bucket[open_], free[open_].argmax(1)] = prints[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
        return all(self._kick(int(prints[i]), int(first[i])) for i in left)

    def _kick(self, fingerprint: int, bucket: int) -> bool:
        for turn in range(MAX_KICKS):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
            slot = (turn + fingerprint) % SLOTS
            moved = int(self.table[bucket, slot])
            self.table[bucket, slot] = fingerprint
            fingerprint = moved
            bucket = int(self._other(np.array([bucket]), np.array([moved], np.uint16))[0])
        return False

    def delete(self, key: np.uint64) -> bool:
        """Free one slot of a key that is known to be live."""
        prints, first, second = self._places(np.array([key], np.uint64))
        for bucket in (first[0], second[0]):
            slot = np.flatnonzero(self.table[bucket] == prints[0])
            if len(slot):
                self.table[bucket, slot[0]] = 0
                return True
        return False


class DigestBucket:
    """Live digests with their counts and kept rows, behind a cuckoo filter."""

    def __init__(self, expected: int):
        self.filter = CuckooFilter(expected)
        self.where: dict[bytes, int] = {}
        self.sha: list[bytes] = []
        self.live: list[int] = []
        self.keep: list[tuple] = []  # (-length, id is null, id, row): the smallest stays

    def __len__(self) -> int:
        return len(self.where)

    @staticmethod
    def _keys(shas: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(s[:8] for s in shas), "<u8").astype(np.uint64)

    def add(self, rows: pa.Table | pa.RecordBatch) -> None:
        best: dict[bytes, list] = {}
        columns = (rows.column(n).to_pylist() for n in ENTRY_SCHEMA.names)
        for sha, live, length, ident, row in zip(*columns, strict=True):
            mine = (-length, ident is None, ident or 0, row)
            seen = best.get(sha)
            if seen is None:
                best[sha] = [live, mine]
            else:
                seen[0] += live
                if mine < seen[1]:
                    seen[1] = mine
        if not best:
            return
        shas = list(best)
        fresh = []
        for sha, hit in zip(shas, self.filter.contains(self._keys(shas)), strict=True):
            at = self.where.get(sha) if hit else None  # a hit counts only if the contents agree
            if at is None:
                fresh.append(sha)
                continue
            self.live[at] += best[sha][0]
            self.keep[at] = min(self.keep[at], best[sha][1])
        for sha in fresh:
            self.where[sha] = len(self.sha)
            self.sha.append(sha)
            self.live.append(best[sha][0])
            self.keep.append(best[sha][1])
        if fresh:
            self.filter.insert(self._keys(fresh), lambda: self._keys(list(self.where)))

    def remove(self, rows: pa.Table | pa.RecordBatch) -> None:
        for sha, gone in zip(rows.column("sha").to_pylist(), rows.column("live").to_pylist(), strict=True):
            key = self._keys([sha])
            at = self.where.get(sha) if self.filter.contains(key)[0] else None
            if at is None:
                continue  # never inserted, or deleted before
            self.live[at] -= gone
            if self.live[at] <= 0:
                self.filter.delete(key[0])
                del self.where[sha]

    def entries(self) -> pa.Table:
        at = list(self.where.values())
        return pa.table(
            [
                pa.array([self.sha[i] for i in at], pa.binary()),
                pa.array([self.live[i] for i in at], pa.int64()),
                pa.array([-self.keep[i][0] for i in at], pa.int64()),
                pa.array([None if self.keep[i][1] else self.keep[i][2] for i in at], pa.int64()),
                pa.array([self.keep[i][3] for i in at], pa.int64()),
            ],
            schema=ENTRY_SCHEMA,
        )


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row (unique), sha (SHA-256 of the text without white space), n_points (code points).

    Stored, because ``row`` must not change between its uses.
    """
    text = text_of(text_column)
    return store(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(F.translate(text, WHITE_SPACE, ""), 256)).alias("sha"),
            F.length(text).cast("long").alias("n_points"),
        ),
        "digests",
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket = DigestBucket(4096)
    for batch in batches:
        bucket.add(batch)
        if len(bucket) >= COMBINED_AT_ONCE:
            yield from bucket.entries().to_batches()
            bucket = DigestBucket(4096)
    yield from bucket.entries().to_batches()


def _as_entries(digested: DataFrame) -> DataFrame:
    rows = digested.select(
        "sha",
        F.lit(1).cast("long").alias("live"),
        F.col("n_points").alias("keep_len"),
        F.col("doc_id").alias("keep_id"),
        F.col("row").alias("keep_row"),
    )
    return rows.mapInArrow(_combine, ENTRY)


def _update_bucket(rows: pa.Table) -> pa.Table:
    kind = rows.column("kind").to_numpy()
    bucket = DigestBucket(len(rows))
    for k in (0, 1):
        bucket.add(rows.filter(pa.array(kind == k)))
    bucket.remove(rows.filter(pa.array(kind == 2)))
    return bucket.entries()


def _bucketed(entries: DataFrame, buckets: int, kind: int) -> DataFrame:
    return entries.select(
        "*",
        F.pmod(F.xxhash64("sha"), F.lit(buckets)).alias("bucket"),
        F.lit(kind).alias("kind"),
    )


class CuckooIndex:
    """Live digests: ``entries`` (sha, live, keep_len, keep_id, keep_row) in ``buckets`` buckets.

    ``keep_id`` and ``keep_row`` name the row with the most code points, then the smallest id
    (null ids last), then the smallest row number. They stay as the group's label when that very
    row is deleted while others of its digest live.
    """

    def __init__(self, entries: DataFrame | None, buckets: int):
        self.entries = entries
        self.buckets = buckets

    @classmethod
    def sized_for(cls, rows: int) -> CuckooIndex:
        return cls(None, max(1, -(-rows // DIGESTS_PER_BUCKET)))

    def _update(self, digested: DataFrame, kind: int) -> CuckooIndex:
        rows = _bucketed(_as_entries(digested), self.buckets, kind)
        if self.entries is not None:
            rows = rows.unionByName(_bucketed(self.entries, self.buckets, 0))
        return CuckooIndex(rows.groupBy("bucket").applyInArrow(_update_bucket, ENTRY), self.buckets)

    def insert(self, digested: DataFrame) -> CuckooIndex:
        """The index after the rows of ``digests(docs)`` were added."""
        return self._update(digested, 1)

    def delete(self, digested: DataFrame) -> CuckooIndex:
        """The index after the rows were taken out; rows that are not live change nothing."""
        return self._update(digested, 2)

    def filters(self) -> DataFrame:
        """bucket, digests, slots, table: the packed filter of each bucket, for storage."""

        def pack(rows: pa.Table) -> pa.Table:
            bucket = DigestBucket(len(rows))
            bucket.add(rows)
            return pa.table(
                {
                    "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int64()),
                    "digests": pa.array([len(bucket)], pa.int64()),
                    "slots": pa.array([bucket.filter.capacity], pa.int64()),
                    "table": pa.array([bucket.filter.table.tobytes()], pa.binary()),
                }
            )

        rows = _bucketed(self.entries, self.buckets, 0)
        return rows.groupBy("bucket").applyInArrow(
            pack, "bucket long, digests long, slots long, table binary"
        )

    def assign(self, digested: DataFrame) -> DataFrame:
        """doc_id, row, sha, and the entry of its digest (null if it is not live)."""
        # the digest side of a hot group is split by adaptive execution; the entry side has one row
        return digested.join(self.entries, "sha", "left")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they agree after white space is deleted; a null text is empty, and empty
    texts are equal to each other. Of rows repeating id and text exactly one is kept. A null id
    loses against any other of the same length and stays null. An empty table gives no rows.
    Only the two named columns are read, so further columns cannot clash.
    """
    digested = digests(docs, id_column, text_column)
    index = CuckooIndex.sized_for(digested.count()).insert(digested)
    return index.assign(digested).select(
        "doc_id",
        "keep_id",
        F.col("live").alias("group_size"),
        (
            (F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        ).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
