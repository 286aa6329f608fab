"""Phrase collocations by partitioned mining (SON) with exact global counts.

The documents are dealt into a few shards by a hash of their text, and words are counted first, per language and per shard. Then
phrases are found length by length: each shard is mined completely, at the global support lowered to its share of
the language's words. A phrase that is frequent in the corpus is so in one shard at least, so the union of what is locally frequent
misses none. A shard is mined by as many tasks as hold its documents: each counts its own phrases first, by a hash, and
Spark adds the counts up. A phrase is mined only if both its parts, without the last and without
the first word, are candidates. Last, all candidates are counted exactly, as texts, over all documents;
hashes and the bitmaps made of them only rule phrases out, so a collision costs a little work and
changes no result.

Tasks combine their counts before anything is shuffled, so a very frequent word or phrase is one row
per task. The number of shards is fixed, since with more of them than the support every phrase would be locally frequent.
Bitmaps have a fixed size; in a corpus with more candidates than bits they filter less.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, string_column, text_of, text_slices, utf8_buffer

#: Shards of the corpus; their local support is about half of the global one.
SHARDS = 2
#: Phrases that a task holds before it counts them and passes the counts on.
PHRASES_AT_ONCE = 5_000_000
#: Words or phrases that one task counts before it passes the counts on.
COUNTED_AT_ONCE = 1 << 18
#: Occurrences of candidates that a task holds as word numbers, and words that it numbers, before it counts them.
OCCURRENCES_AT_ONCE, NUMBERED_AT_ONCE = 1_000_000, 1 << 18
#: Languages whose local support is lowered by their shares; in others it is 1, which is always safe.
LANGUAGES = 10_000
#: Bits of the bitmaps that rule words and phrases out: 8 MB each.
FILTER_BITS = 1 << 26
CHUNK_BITS = 1 << 15
#: Bytes of texts that are split into words together.
SLICE = 2 << 20
#: Bits of a hash by which phrases are mined; equal ones are one candidate more at worst.
NAME_BITS = np.uint64((1 << 40) - 1)
#: Rows of one Arrow batch that a task passes on.
ROWS_AT_ONCE = 100_000
NO_LANGUAGE = "und"

#: What a byte is: part of a word, between words, or the end of a piece.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers of the words of a phrase, by place; longer phrases than that are not mined.
MAX_WORDS = 8
_PLACES = np.random.default_rng(20251201).integers(1 << 62, 1 << 63, MAX_WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: distinct ones, the code of each word in place, and which words continue a piece."""

    def __init__(self, texts: pa.Array):
        raw, bounds = utf8_buffer(texts)
        kind = _KINDS[raw]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = np.flatnonzero(np.diff(bounds) > 0)
        starts, ends = bounds[filled], bounds[filled + 1] - 1
        first[starts] = inside[starts]  # a text begins and ends its own words
        last[ends] = inside[ends]
        begin = np.flatnonzero(first)
        lengths = np.flatnonzero(last) - begin + 1
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        letters = _LOWER[raw[inside]]
        words = pa.LargeStringArray.from_buffers(
            len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)
        )
        coded = words.dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.count = len(self.codes)
        #: first word of each text, and the end
        self.bounds = np.searchsorted(begin, bounds)
        breaks = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(begin) else np.empty(0, np.int32)
        self.goes_on = np.zeros(self.count, bool)  # the next word is in the same piece
        self.goes_on[:-1] = breaks[1:] == breaks[:-1]
        inner = self.bounds[(self.bounds > 0) & (self.bounds <= self.count)]
        self.goes_on[inner - 1] = False

    def hashes(self) -> np.ndarray:
        raw, bounds = utf8_buffer(self.distinct)
        data, ends = raw.tobytes(), bounds.tolist()
        found = (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:]))
        return np.fromiter(found, np.uint64, len(ends) - 1)


def _by_shard(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[tuple[str, int, int, int]]]]:
    """Slices of texts in order of language and shard, and (language, shard, first text, end) of each run."""
    languages = batch.column("lang").dictionary_encode()
    names = languages.dictionary.to_pylist()
    codes = languages.indices.to_numpy().astype(np.int64) * SHARDS + batch.column("shard").to_numpy()
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    for start, texts in text_slices(string_column(batch, "text").take(pa.array(order)), 2000, SLICE):
        own = codes[start : start + len(texts)]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        yield texts, [(names[own[a] // SHARDS], int(own[a] % SHARDS), a, b) for a, b in zip(cuts, cuts[1:])]


def _counted(total: Counter[tuple[str, str]], words: int) -> Iterator[pa.RecordBatch]:
    items = list(total.items())
    for at in range(0, len(items), ROWS_AT_ONCE):
        part = items[at : at + ROWS_AT_ONCE]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k, _ in part], pa.string()),
                pa.array([words] * len(part), pa.int32()),
                pa.array([k[1] for k, _ in part], pa.string()),
                pa.array([n for _, n in part], pa.int64()),
            ],
            names=["lang", "words", "phrase", "n"],
        )


COUNTS = "lang string, words int, phrase string, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and as ``words`` 0 the number of words of each shard, with its number as ``phrase``."""
    total: Counter[tuple[str, str]] = Counter()
    sizes: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for texts, segments in _by_shard(batch):
            words = Words(texts)
            names = words.distinct.to_pylist()
            for lang, shard, a, b in segments:
                own = words.codes[words.bounds[a] : words.bounds[b]]
                sizes[lang, str(shard)] += len(own)
                found = np.bincount(own, minlength=len(names))
                for code in np.flatnonzero(found).tolist():
                    total[lang, names[code]] += int(found[code])
            if len(total) >= COUNTED_AT_ONCE:
                yield from _counted(total, 1)
                total.clear()
    yield from _counted(total, 1)
    yield from _counted(sizes, 0)


class Phrases:
    """Where phrases of each length begin that the bitmaps (of 1, 2, ... words) have not ruled out.

    Only texts a to b, all of one language; ``of_words`` are the hashes of the distinct words.
    """

    def __init__(
        self, words: Words, of_words: np.ndarray, lang: str, a: int, b: int, bitmaps: list[np.ndarray], longest: int
    ):
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        start, end = words.bounds[a], words.bounds[b]
        self.codes = words.codes[start:end]
        hashed = _mix(of_words[self.codes] ^ seed)
        goes_on = words.goes_on[start:end]
        able = _inside(bitmaps[0], hashed)
        self.able, self.hash = {1: able}, {1: hashed}
        rolled = hashed * _PLACES[0]
        for n in range(2, longest + 1):
            size = max(len(hashed) - n + 1, 0)
            rolled = rolled[:size] + hashed[n - 1 :][:size] * _PLACES[n - 1]
            self.hash[n] = _mix(rolled + np.uint64(n))
            # both parts are candidates, and the last word is in the same piece
            able = able[:size] & able[1:][:size] & goes_on[n - 2 :][:size]
            if n <= len(bitmaps):
                able = able & _inside(bitmaps[n - 1], self.hash[n], able)
            self.able[n] = able


def _inside(bitmap: np.ndarray, hashed: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """Which hashes have their bit set; only where ``asked``."""
    found = np.zeros(len(hashed), bool)
    at = np.arange(len(hashed)) if asked is None else np.flatnonzero(asked)
    bit = hashed[at] & np.uint64(FILTER_BITS - 1)
    found[at] = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _mine(n: int, bitmaps, numbers: dict[str, int]):
    """Count phrases of ``n`` words in each task: hash, cell (number of the language and shard, or -1) and count."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        filters, held = [b.value for b in bitmaps], 0

        def counts() -> Iterator[pa.RecordBatch]:
            for cell, arrays in found.items():
                hashed, many = np.unique(np.concatenate(arrays) & NAME_BITS, return_counts=True)
                for at in range(0, len(hashed), ROWS_AT_ONCE):
                    part = hashed[at : at + ROWS_AT_ONCE].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array(np.full(len(part), cell, np.int32)), pa.array(many[at : at + ROWS_AT_ONCE])],
                        names=["hash", "cell", "n"],
                    )

        for batch in batches:
            for texts, segments in _by_shard(batch):
                words = Words(texts)
                hashed = words.hashes()
                for lang, shard, a, b in segments:
                    spots = Phrases(words, hashed, lang, a, b, filters, n)
                    mined = spots.hash[n][spots.able[n]]
                    cell = numbers[lang] * SHARDS + shard if lang in numbers else -1
                    found.setdefault(cell, []).append(mined)
                    held += len(mined)
                if held >= PHRASES_AT_ONCE:
                    yield from counts()
                    found.clear()
                    held = 0
        yield from counts()

    return mine


class _Occurrences:
    """Occurrences of phrases as the numbers of their words, which a task gives out itself, so counts are exact."""

    def __init__(self, longest: int):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.languages: dict[str, int] = {}
        self.found: dict[int, list[np.ndarray]] = {n: [] for n in range(2, self.longest + 1)}
        self.held = 0

    def add(self, words: Words, lang: str, spots: Phrases) -> None:
        places = {n: np.flatnonzero(spots.able[n]) for n in self.found}
        inside = np.zeros(len(spots.codes), bool)
        for n, at in places.items():
            for k in range(n):
                inside[at + k] = True
        used = np.unique(spots.codes[inside])
        numbers = np.zeros(len(words.distinct), np.int32)
        number = self.number
        numbers[used] = [number.setdefault(w, len(number)) for w in words.distinct.take(pa.array(used)).to_pylist()]
        language = self.languages.setdefault(lang, len(self.languages))
        for n, at in places.items():
            rows = np.full((n + 1, len(at)), language, np.int32)
            for k in range(n):
                rows[k] = numbers[spots.codes[at + k]]
            self.found[n].append(rows)
            self.held += len(at)

    def counts(self) -> Iterator[pa.RecordBatch]:
        words = pa.array(list(self.number), pa.large_string())
        languages = pa.array(list(self.languages), pa.string())
        for n, parts in self.found.items():
            if not parts:
                continue
            rows = np.concatenate(parts, axis=1)
            key = rows[n].astype(np.int64)
            for k in range(n):
                key = key * len(words) + rows[k]
                if k < n - 1 and k:  # equal words at all places so far have equal keys; two numbers fit in 64 bits
                    key = np.unique(key, return_inverse=True)[1]
            _, first, many = np.unique(key, return_index=True, return_counts=True)
            for at in range(0, len(first), ROWS_AT_ONCE):
                some = rows[:, first[at : at + ROWS_AT_ONCE]]
                parts_of = [words.take(pa.array(some[k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts_of, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [languages.take(pa.array(some[n])), pa.array(np.full(some.shape[1], n, np.int32)), phrase, pa.array(many[at : at + ROWS_AT_ONCE])],
                    names=["lang", "words", "phrase", "n"],
                )


def _count_phrases(bitmaps, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Occurrences(longest)
        filters = [b.value for b in bitmaps]
        for batch in batches:
            for texts, segments in _by_shard(batch):
                words = Words(texts)
                hashed = words.hashes()
                for lang, _, a, b in segments:
                    held.add(words, lang, Phrases(words, hashed, lang, a, b, filters, longest))
                if held.held >= OCCURRENCES_AT_ONCE or len(held.number) >= NUMBERED_AT_ONCE:
                    yield from held.counts()
                    held.clear()
        yield from held.counts()

    return count


def _bitmap(spark, hashes: DataFrame):
    """The broadcast bitmap of a column ``hash``; its size is fixed."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    chunks = (
        hashes.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", CHUNK_BITS.bit_length() - 1).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(CHUNK_BITS - 1))).alias("bits"))
        .toArrow()  # FILTER_BITS / CHUNK_BITS rows at most
    )
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    size = CHUNK_BITS // 8
    for chunk, bits in zip(chunks.column("chunk").to_pylist(), chunks.column("bits").to_pylist()):
        bitmap[chunk * size : (chunk + 1) * size] = np.frombuffer(bits, np.uint8)
    return spark.sparkContext.broadcast(bitmap)


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in batch.column("lang").to_pylist()]
        words = [xxhash.xxh3_64_intdigest(x.encode()) for x in batch.column("phrase").to_pylist()]
        hashed = _mix(np.array(words, np.uint64) ^ np.array(seeds, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64))], names=["hash"])


def counted_phrases(
    docs: DataFrame, longest: int = 3, least: int = 10, text_column: str = "text", lang_column: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(words, phrases), both lang, words, phrase, n and stored.

    The first holds every word of that support with its count, and as ``words`` 0 the sizes of the shards, the second every phrase of 2 to ``longest`` words
    that occurs ``least`` times or more in its language.
    """
    if not 2 <= longest <= MAX_WORDS:
        raise ValueError(f"phrases have 2 to {MAX_WORDS} words")
    spark = docs.sparkSession
    text = text_of(text_column)
    texts = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.pmod(F.xxhash64(text), F.lit(SHARDS)).cast("int").alias("shard"),
        text.alias("text"),
    )
    counted = store(
        texts.mapInArrow(_count_words, COUNTS)
        .groupBy("lang", "words", "phrase")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= least) | (F.col("words") == 0)),
        "words",
    )
    words = counted.filter("words = 1")
    sizes = counted.filter("words = 0").select("lang", F.col("phrase").cast("int").alias("shard"), "n")
    total = sizes.groupBy("lang").agg(F.sum("n").alias("total"))
    largest = total.orderBy(F.desc("total"), "lang").limit(LANGUAGES)
    numbers = {r["lang"]: i for i, r in enumerate(largest.collect())}
    cells = sizes.join(largest, "lang").collect()  # at most LANGUAGES x SHARDS rows
    supports = spark.createDataFrame(
        # the quotient rounded up; a shard without words of the language has none of its phrases
        [(numbers[r["lang"]] * SHARDS + r["shard"], max(1, -(-least * r["n"] // max(r["total"], 1)))) for r in cells],
        "cell int, support long",
    )
    frequent = words.filter(F.col("n") >= least).select("lang", "phrase")
    bitmaps = [_bitmap(spark, frequent.mapInArrow(_word_hashes, "hash long"))]
    for n in range(2, longest + 1):
        mined = texts.mapInArrow(_mine(n, bitmaps, numbers), "hash long, cell int, n long")
        local = mined.groupBy("hash", "cell").agg(F.sum("n").alias("n")).join(F.broadcast(supports), "cell", "left")
        bitmaps.append(_bitmap(spark, local.filter(F.col("n") >= F.coalesce("support", F.lit(1))).select("hash")))
    phrases = store(
        texts.mapInArrow(_count_phrases(bitmaps, longest), COUNTS)
        .groupBy("lang", "words", "phrase")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least),
        "phrases",
    )
    return counted, phrases


def _cut(phrase: Column, first: int, words: int) -> tuple[Column, Column]:
    """The first words of a phrase, and the rest."""
    parts = F.split(phrase, " ")
    return F.array_join(F.slice(parts, 1, first), " "), F.array_join(F.slice(parts, first + 1, words), " ")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    absorbed: int = 50,
    top: int = 2000,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Words are runs without space and tab, lower-cased in A-Z, inside pieces between punctuation and
    line ends. ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut whose score
    floor(1000000 * a * a / (l * r)) is lowest (ties: the earliest cut), ``n`` all words of the language. A
    phrase with ``100 * f >= absorbed * a`` for the count f of a longer phrase around it is left
    out. Ties go to the larger ``a``, then to the phrase in byte order. A null text is empty, a null
    language ``und``; repeated rows count repeatedly; without phrases of that support there are no
    rows. Only the two named columns are read.
    """
    counted, phrases = counted_phrases(docs, longest, least, text_column, lang_column)
    words = counted.filter("words = 1")
    sizes = counted.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    # parts of a frequent phrase are frequent, so every part is in one of the two tables
    parts = words.filter(F.col("n") >= least).union(phrases)
    scored = None
    for n in range(2, longest + 1):
        for k in range(1, n):
            left, right = _cut(F.col("phrase"), k, n)
            one = phrases.filter(F.col("words") == n).select(
                "lang", "words", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), left.alias("left"), right.alias("right")
            )
            scored = one if scored is None else scored.unionByName(one)
    l = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    r = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # quotients of whole numbers of 38 digits; a score is never above 1000000
    exact = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * 1000000BD div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    cuts = scored.join(l, ["lang", "left"]).join(r, ["lang", "right"]).withColumn("score", F.expr(exact))
    lowest = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    around = None
    for n in range(3, longest + 1):
        for m in range(2, n):
            for at in range(n - m + 1):
                inner = F.array_join(F.slice(F.split("phrase", " "), at + 1, m), " ")
                one = phrases.filter(F.col("words") == n).select("lang", inner.alias("phrase"), F.col("n").alias("f"))
                around = one if around is None else around.unionByName(one)
    if around is not None:
        fullest = around.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
        lowest = lowest.join(fullest, ["lang", "phrase"], "left").filter(
            F.coalesce(100 * F.col("f") < absorbed * F.col("a"), F.lit(True))
        )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = lowest.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
