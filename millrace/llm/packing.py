"""Pack tokenised documents into sequences of a fixed capacity by patterns fitted to the length histogram.

A document is its ids and an end id; one longer than the capacity is cut into pieces. Only the
histogram of piece lengths comes to the driver, ``capacity`` numbers at most. All patterns of up to
three lengths that fill a sequence exactly are enumerated, and non-negative least squares finds how
often each is repeated so that together they use up the histogram. The repeat counts are rounded, and what they
leave over is packed best-fit by decreasing length, also as counts. The plan so made says, for each length, which
run of its pieces goes to which place of which sequences. Spark numbers the pieces of each length, from the counts of each task,
and looks every piece up in the plan.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import store, string_column, text_of, text_slices, utf8_buffer

CAPACITY, END_ID = 1024, 2
#: Lengths of a pattern at most.
PARTS = 3
#: Steps of the least-squares fit.
STEPS = 600
#: Bytes of texts that are encoded together, and characters after which a long text may be cut between words.
SLICE, CHUNK = 8 << 20, 1 << 20

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# The characters with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the vocabulary's pattern splits off.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of every code point; those that this Unicode version lacks are unknown."""
    first = {"L": LETTER, "N": NUMBER}
    found = np.fromiter(
        (UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else first.get(c[0], OTHER) for i in range(0x110000)),
        np.uint8,
        0x110000,
    )
    found[WHITE] = SPACE
    return found


def split_starts(points: np.ndarray, chunk_starts: np.ndarray) -> np.ndarray:
    """Whether each code point begins a piece, as the byte-level pattern splits each chunk.

    One space joins the run of letters, numbers or other characters behind it; of several white-space characters the
    last stays behind; an apostrophe that begins a piece takes a contraction's letters with it.
    """
    kind = character_classes()[points]
    n = len(points)
    own = np.zeros(n + 1, bool)  # the end begins a chunk, too
    own[chunk_starts] = True
    own[n] = True
    begins = own[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    blank = np.empty(n, bool)
    blank[0], blank[1:] = False, points[:-1] == 0x20
    blank &= ~own[:n]
    starts = begins & ~((kind != SPACE) & blank)
    behind_space = np.flatnonzero(begins & (kind != SPACE) & (before == SPACE) & ~own[:n])
    starts[behind_space - 1] = True
    quotes = np.flatnonzero((points == 0x27) & begins & ~blank)
    quotes = quotes[(quotes + 1 < n) & ~own[np.minimum(quotes + 1, n)]]
    quotes = quotes[kind[quotes + 1] == LETTER]
    if len(quotes):
        taken = np.zeros(len(quotes), np.int64)
        for ending in CONTRACTIONS:
            fits = np.ones(len(quotes), bool)
            for k, letter in enumerate(ending, 1):
                at = np.minimum(quotes + k, n - 1)
                fits &= (quotes + k < n) & (points[at] == ord(letter)) & ~own[at]
            taken[fits] = len(ending)
        quotes, taken = quotes[taken > 0], taken[taken > 0]
        starts[quotes + 1] = False
        ends = quotes + taken + 1
        # where the letters go on, the rest is a piece of its own
        starts[ends[ends < n]] = True
    return starts


def _chunks(text: str) -> Iterator[str]:
    """A long text in parts that no piece crosses: each begins with a space behind a character that is none."""
    start = 0
    while len(text) - start > CHUNK:
        cut = start + CHUNK
        while (cut := text.find(" ", cut)) > 0 and character_classes()[ord(text[cut - 1])] == SPACE:
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


class Encoder:
    """Ids of many texts at once: vectorised splitting, and each distinct piece merged once."""

    def __init__(self, names: str, ranks: dict[bytes, int], pattern: str):
        self.exact = Tokenizer.from_str(names)
        self.exact.no_padding()
        self.exact.no_truncation()
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.merge = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces end to end, and the number of ids of each.

        White-space pieces are few. The others are merged in one call with a line end, which is a piece of its own and
        in none of them, between any two.
        """
        raw, bounds = utf8_buffer(pieces)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        last = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), bounds[1:]) - 1
        blank = character_classes()[points[last]] == SPACE  # only white space ends in white space
        words = pieces.filter(pa.array(~blank))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "\n")
        found = self.merge.encode_to_numpy(joined[0].as_py() or "", disallowed_special=())
        ends = np.append(np.flatnonzero(found == self.line_end), len(found))
        counts = np.zeros(len(pieces), np.int64)
        if len(words):
            counts[~blank] = np.diff(ends, prepend=-1) - 1
        blanks = [self.merge.encode_ordinary(w) for w in pieces.filter(pa.array(blank)).to_pylist()]
        counts[blank] = [len(ids) for ids in blanks]
        ids = np.empty(int(counts.sum()), np.uint32)
        white = np.repeat(blank, counts)
        ids[~white] = found[found != self.line_end]
        ids[white] = np.fromiter(chain.from_iterable(blanks), np.uint32, int(white.sum()))
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 bounds of the texts."""
        raw, bounds = utf8_buffer(texts)
        data = raw.tobytes()
        whole = data.decode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        # code points before each byte; the bytes 10xxxxxx go on with one
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        firsts = np.searchsorted(leads, bounds)
        unknown = np.flatnonzero(character_classes()[points] == UNKNOWN)
        odd = set((np.searchsorted(firsts, unknown, side="right") - 1).tolist())
        for token in self.added:
            if token in whole:
                odd |= {i for i, text in enumerate(texts.to_pylist()) if token in text}
        chunk_starts = set(firsts[:-1].tolist())
        for i in np.flatnonzero(np.diff(firsts) > CHUNK).tolist():
            chunk_starts |= {firsts[i] + a for a in np.cumsum([len(c) for c in _chunks(texts[i].as_py())])[:-1].tolist()}
        starts_of_chunks = np.array(sorted(c for c in chunk_starts if c < len(points)), np.int64)
        begin = np.flatnonzero(split_starts(points, starts_of_chunks)) if len(points) else np.empty(0, np.int64)
        offsets = np.append(leads[begin], len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        flat, lengths = self.merged(coded.dictionary)
        codes = coded.indices.to_numpy()
        sizes = lengths[codes] if len(codes) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        # the place of each id: where its piece begins in ``flat``, and how far it is inside the piece
        shift = (np.cumsum(lengths) - lengths)[codes] - (ends - sizes) if len(codes) else sizes
        ids = flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]
        by_text = np.concatenate(([0], ends))[np.searchsorted(begin, firsts)]
        if odd:
            parts = [ids[a:b] for a, b in zip(by_text[:-1], by_text[1:])]
            for i in odd:
                parts[i] = np.array(self.exact.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            by_text = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, by_text


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long"


def _cut_pieces(names: str, ranks: dict[bytes, int], pattern: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(names, ranks, pattern), TaskContext.get().partitionId()
        turns = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for first, texts in text_slices(string_column(batch, "text"), 2000, SLICE):
                ids, bounds = encoder.encode(texts)
                sizes = np.diff(bounds) + 1
                ended = np.full(len(ids) + len(sizes), END_ID, "<u4")
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                # only the first piece of a document may be shorter
                short = sizes - (counts - 1) * capacity
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                at = (bounds[:-1] + np.arange(len(sizes)))[row] + start
                crc = [zlib.crc32(ended[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                turn = np.empty(len(row), np.int64)
                turn[order] = turns[ordered] + np.arange(len(row)) - np.searchsorted(ordered, ordered)
                turns += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)).take(pa.array(row)),
                        pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                        pa.array(np.full(len(row), task), pa.int32()), pa.array(turn),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "turn"],
                )

    return cut


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ascending triples of the given lengths, or zeros in front, that add up to the capacity."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = True  # a missing part
    found = []
    for a in np.flatnonzero(there[: capacity // PARTS + 1]).tolist():
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        fits = there[b] & there[c]
        found.append(np.stack([np.full(fits.sum(), a), b[fits], c[fits]], 1))
    return np.concatenate(found)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats whose use of each length is nearest to its count in the least-squares sense.

    Accelerated projected gradient; steps are scaled per pattern by its parts' share in the normal equations.
    """
    size = len(counts)
    wanted = counts / max(counts.max(), 1)
    wanted[0] = 0
    weight = np.ones(size)
    weight[0] = 0  # a missing part uses nothing

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(patterns[:, k], x, size) for k in range(PARTS)) * weight

    def gradient(x: np.ndarray) -> np.ndarray:
        rest = used(x) - wanted
        return rest[patterns].sum(1)

    # Gershgorin: a row of the normal equations sums to what its parts are used by one repeat of every pattern
    scale = 1 / np.maximum(used(np.ones(len(patterns)))[patterns].sum(1), 1)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - scale * gradient(y), 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum = new - x
        if (gradient(new) * momentum).sum() > 0:  # start the acceleration anew
            t_new, momentum = 1.0, np.zeros(len(new))
        y, x, t = new + (t - 1) / t_new * momentum, new, t_new
    return x * max(counts.max(), 1)


@dataclass
class Plan:
    """Runs of the pieces of each length in the sequences.

    Pieces are numbered length by length. Run i begins with piece ``first[i]``; its pieces go, ``each[i]`` to a sequence,
    to the sequences from ``sequence[i]`` on, at ``offset[i]`` and the places behind it.
    """

    before: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, how many in each)]) by best-fit decreasing; equal sequences are one entry."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for space in range(length, capacity):
            if left and space in room:
                groups, rest = room.pop(space), []
                for sequences, content in groups:
                    many = space // length
                    full = min(sequences, left // many)
                    if full:
                        left -= full * many
                        room.setdefault(space - many * length, []).append((full, [*content, (length, many)]))
                        sequences -= full
                    if sequences and 0 < left < many:
                        room.setdefault(space - left * length, []).append((1, [*content, (length, left)]))
                        sequences, left = sequences - 1, 0
                    if sequences:
                        rest.append((sequences, content))
                if rest:
                    room.setdefault(space, []).extend(rest)
        many = capacity // length
        if left // many:
            room.setdefault(capacity - many * length, []).append((left // many, [(length, many)]))
        if left % many:
            room.setdefault(capacity - left % many * length, []).append((1, [(length, left % many)]))
    return [group for groups in room.values() for group in groups]


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """Sequences for ``counts[length]`` pieces of each length from 1 to the capacity."""
    counts = counts.astype(np.int64)
    left = counts.copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    patterns = patterns_of(np.flatnonzero(counts), capacity)
    if len(patterns):
        repeats = np.rint(fit_repeats(patterns, counts)).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)].tolist():
            lengths, many = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            # the fit may use a little more of a length than there is
            sequences = int(min(repeats[i], (left[lengths] // many).min()))
            if sequences:
                left[lengths] -= sequences * many
                groups.append((sequences, list(zip(lengths.tolist(), many.tolist()))))
    groups += best_fit(left, capacity)
    before = np.concatenate(([0], np.cumsum(counts)))
    taken, runs, base = np.zeros(capacity + 1, np.int64), [], 0
    for sequences, content in groups:
        offset = 0
        for length, many in content:
            runs.append((before[length] + taken[length], base, offset, many))
            taken[length] += sequences * many
            offset += length * many
        base += sequences
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(before, *columns.T, base)


def _placed(plan: Plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = plan.before[length] + batch.column("rank").to_numpy()
            run = np.searchsorted(plan.first, number, side="right") - 1
            inside = number - plan.first[run]
            sequence = plan.sequence[run] + inside // plan.each[run]
            offset = plan.offset[run] + inside % plan.each[run] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame,
    names: str,
    ranks: dict[bytes, int],
    pattern: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    ``names`` is the vocabulary's JSON, ``ranks`` the same vocabulary as byte strings and ``pattern`` its way to split.
    A null or empty text is one piece with the end id alone. A document longer than the capacity is
    cut into full pieces behind a first one that may be shorter. Repeated rows and null ids are
    packed like others; an empty table gives no rows. Only the two named columns are read. Sequences
    are numbered from 0 without gaps, and so are the places inside each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    pieces = store(texts.mapInArrow(_cut_pieces(names, ranks, pattern, capacity), PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # one row per task in the window of a length
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = plan_packing(counts, capacity)
    ranked = pieces.join(offsets.select("length", "task", "ahead"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("turn")).alias("rank")
    )
    return ranked.mapInArrow(
        _placed(plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
