"""Byte-pair encoding and decoding with a lexicon compiled into a minimal acyclic transducer.

The corpus is counted in pieces between ASCII white space. The frequent pieces, each with its token
ids, become a minimal acyclic automaton: equal suffixes share their states, and every arc carries
the number of words it skips, so the sum along a word is its place in the pool of ids. The bytes of
the automaton are sent to the tasks, which map them from a file and walk all distinct pieces of a batch
through it at once. A piece the automaton does not accept is normalised, split and merged by the
ranks of the vocabulary, so the result never depends on the choice of the lexicon.

No rule of the vocabulary crosses ASCII white space, which makes pieces independent: the
normaliser and the splitting pattern treat it as a boundary, and special tokens contain none.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import store, string_column, text_slices, utf8_buffer

#: At most so many words are compiled, which bounds the automaton to a few megabytes.
LEXICON_WORDS = 1 << 17
#: Pieces one task counts, and words it remembers after merging them, before it starts anew.
COUNTED = 1 << 18
REMEMBERED = 1 << 17
ROWS_AT_ONCE = 500


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Merger:
    """Exact encoding of pieces by the merge ranks of a vocabulary with word ends.

    Words are merged together, one merge of each in a step: pairs of adjacent symbols are looked up in a
    sorted table of all merges, and every word merges its pair of the least rank.
    """

    ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, vocabulary: str):
        parsed = json.loads(vocabulary)
        model = parsed["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.find_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(vocabulary)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(128)}
        self.known: dict[str, list[int]] = {}
        # ids of each letter inside and at the end of a word, by code point
        self.inside, self.last = (np.full(512, -1, np.int64) for _ in range(2))
        for letter in letters:
            self.inside[ord(letter)] = self.ids.get(letter, -1)
            self.last[ord(letter)] = self.ids.get(letter + self.end, -1)
        if min(x[[ord(c) for c in letters]].min() for x in (self.inside, self.last)) < 0:
            raise ValueError("the vocabulary lacks a byte")
        size = max(self.ids.values()) + 1
        keys = np.array([self.ids[a] * size + self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank = size, keys[order], order
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.int64)[order]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; pieces hold no ASCII white space."""
        parts = [self._parts(p) for p in pieces]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        fresh = list({w for words in parts for w in words if isinstance(w, str) and w not in self.known})
        self.known.update(zip(fresh, self._merge(fresh)))
        known = self.known
        return [[i for w in words for i in ((w,) if isinstance(w, int) else known[w])] for words in parts]

    def _parts(self, piece: str) -> list[str | int]:
        """The words of a piece in byte letters; special tokens are their ids already."""
        if self.find_special is None or not self.find_special.search(piece):
            return self._words(piece)
        found: list[str | int] = []
        for part in self.find_special.split(piece):
            found += [self.special[part]] if part in self.special else self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            words = self.ASCII_PARTS.findall(text.lower())
            return words if text.isprintable() else [w.translate(self.to_letters) for w in words]
        # composition, case and letter classes of other scripts come from the library's tables
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) if w]

    def _merge(self, words: list[str]) -> list[list[int]]:
        done: list[list[int]] = [[]] * len(words)
        if not words:
            return done
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ends = np.append(owner[1:] != owner[:-1], True)
        symbol = np.where(ends, self.last[points], self.inside[points])
        while True:
            same = owner[1:] == owner[:-1]
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            can = same & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)
            rank = np.append(np.where(can, self.rank[at] if len(self.keys) else 0, len(self.keys)), len(self.keys))
            first = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, first)
            finished = best == len(self.keys)
            bounds = np.append(first, len(symbol)).tolist()
            for k in np.flatnonzero(finished).tolist():
                done[owner[bounds[k]]] = symbol[bounds[k] : bounds[k + 1]].tolist()
            if finished.all():
                return done
            length = np.diff(bounds)
            wanted = np.repeat(best, length)
            hit = np.flatnonzero((rank == wanted) & (rank < len(self.keys)))
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # the leftmost of each word
            symbol[hit] = self.merged[at[hit]]
            stay = np.repeat(~finished, length)
            stay[hit + 1] = False
            symbol, owner = symbol[stay], owner[stay]


class Lexicon:
    """A minimal acyclic transducer from words to token ids, as flat arrays."""

    FIELDS = ("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("final", np.int32), ("starts", np.int64), ("ids", np.int32)

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        """The automaton of the given words, built from sorted words with one register of states."""
        register: dict[tuple, int] = {}
        counts: list[int] = []  # words below each frozen state
        finals: list[bool] = []
        arcs: list[tuple] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs)
                arcs.append(key[1])
                finals.append(node[0])
                counts.append(node[0] + sum(counts[t] for _, t in key[1]))
            return state

        path = [[False, []]]  # the states of the last word that may still change: [final, arcs]
        last = b""
        words = sorted(entries)
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            for depth in range(len(last), shared, -1):
                path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
            path.extend([False, []] for _ in word[shared:])
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        root = freeze(path[0])
        keys, targets, skips = [], [], []
        # the root becomes state 0 by swapping numbers with it
        name = {root: 0, 0: root}
        for state in sorted(range(len(arcs)), key=lambda s: name.get(s, s)):
            before = int(finals[state])
            for byte, target in arcs[state]:
                keys.append(name.get(state, state) << 8 | byte)
                targets.append(name.get(target, target))
                skips.append(before)
                before += counts[target]
        final = np.zeros(len(arcs), np.int32)
        final[[name.get(s, s) for s in range(len(arcs)) if finals[s]]] = 1
        ids = [entries[w] for w in words]
        arrays = {
            "keys": keys, "targets": targets, "skips": skips, "final": final,
            "starts": np.cumsum([0, *map(len, ids)]), "ids": [i for x in ids for i in x],
        }
        flat = [np.asarray(arrays[n], kind) for n, kind in cls.FIELDS]
        head = np.array([len(a) for a in flat], np.int64)
        return b"".join([head.tobytes(), *(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in flat)])

    @classmethod
    def map(cls, packed: bytes) -> Lexicon:
        """Map the packed automaton from an unnamed file, which goes with the process."""
        file = tempfile.TemporaryFile()
        file.write(packed)
        file.flush()
        data = np.memmap(file, mode="r")
        sizes = np.frombuffer(data[: 8 * len(cls.FIELDS)].tobytes(), np.int64)
        arrays, at = {}, 8 * len(cls.FIELDS)
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist()):
            nbytes = n * np.dtype(kind).itemsize
            arrays[name] = data[at : at + nbytes].view(kind)
            at += -(-nbytes // 8) * 8
        return cls(arrays)

    def find(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The place of each word in the lexicon, or -1; all words step through it together."""
        lengths = np.diff(bounds)
        state = np.zeros(len(lengths), np.int64)
        place = np.zeros(len(lengths), np.int64)
        alive = np.arange(len(lengths)) if len(self.keys) else np.empty(0, np.int64)
        result = np.full(len(lengths), -1, np.int64)
        depth = 0
        while len(alive):
            ended = lengths[alive] == depth
            done = alive[ended]
            accepted = done[self.final[state[done]] == 1]
            result[accepted] = place[accepted]
            alive = alive[~ended]
            if not len(alive):
                break
            key = state[alive] << 8 | raw[bounds[alive] + depth]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            found = self.keys[arc] == key
            alive, arc = alive[found], arc[found]
            place[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            depth += 1
        return result


def _pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all pieces in order, the distinct pieces, and the n + 1 bounds of each text."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.concatenate(([0], np.cumsum(counts)))


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"]
        )

    for batch in batches:
        texts = string_column(batch, "text")
        for _, some in text_slices(texts):
            codes, distinct, _ = _pieces(some)
            for piece, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                total[piece] += n
            if len(total) >= COUNTED:
                yield out()
                total.clear()
    yield out()


def frequent_pieces(docs: DataFrame, limit: int = LEXICON_WORDS, text_column: str = "text") -> list[str]:
    """The pieces above the count at which no more than ``limit`` remain; all documents are counted."""
    counts = store(
        docs.select(F.col(text_column).alias("text"))
        .mapInArrow(_count_pieces, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .filter("piece <> ''"),
        "pieces",
    )
    # how many pieces occur so often, by powers of a twentieth of a factor of two: a few hundred rows
    step = F.floor(F.log2("n") * 20).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True)
    total, least = 0, None
    for row in steps:
        total += row["k"]
        if total > limit:
            break
        least = row["step"]
    if least is None:
        return []
    return [r["piece"] for r in counts.filter(step >= least).select("piece").collect()]


def encode(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """doc_id, ids: the token ids of every text, without special tokens added around it.

    ``vocabulary`` is the JSON of a tokenizer with word ends. Special tokens spelled out in a text
    become their ids, as in the library. A null, empty or blank text has no ids. Every row is
    encoded, repeated ones too; an empty table gives no rows. Only the two named columns are read.
    """
    merger = Merger(vocabulary)
    frequent = frequent_pieces(docs, lexicon_words, text_column)
    packed = Lexicon.compile(dict(zip((p.encode() for p in frequent), merger.encode(frequent))))
    sent = docs.sparkSession.sparkContext.broadcast((packed, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, vocabulary = sent.value
        lexicon, merger = Lexicon.map(packed), Merger(vocabulary)
        for batch in batches:
            texts = string_column(batch, "text")
            for start, some in text_slices(texts):
                ids, bounds = _encode(some, lexicon, merger)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(some)), lists], names=["doc_id", "ids"]
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def _encode(texts: pa.Array, lexicon: Lexicon, merger: Merger) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct, bounds = _pieces(texts)
    place = lexicon.find(*utf8_buffer(distinct))
    unseen = np.flatnonzero(place < 0)
    merged = merger.encode(distinct.take(pa.array(unseen)).to_pylist())
    # ids of the unseen pieces go behind the lexicon's pool
    pool = np.concatenate([lexicon.ids, np.array([i for x in merged for i in x], np.int32)])
    first, length = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    seen = place >= 0
    first[seen] = lexicon.starts[place[seen]]
    length[seen] = lexicon.starts[place[seen] + 1] - first[seen]
    length[unseen] = [len(x) for x in merged]
    first[unseen] = len(lexicon.ids) + np.cumsum(length[unseen]) - length[unseen]
    each = length[codes]
    ends = np.concatenate(([0], np.cumsum(each)))
    ids = pool[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
    return ids, ends[bounds]


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids", as_column: str = "decoded") -> DataFrame:
    """Add the text of the ids as the library's ``decode`` with special tokens kept gives it.

    This vocabulary has no decoder of its own, so tokens are joined by spaces. A null list decodes
    to the empty text, and so do ids outside the vocabulary. ``as_column`` of the input, if any, is
    replaced.
    """
    parsed = json.loads(vocabulary)
    names = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    by_id = [""] * (max(names.values()) + 1)
    for token, i in names.items():
        by_id[i] = token
    known = [token in names for token in by_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(by_id, pa.large_string())
        exists = np.array(known)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists = part.column(ids_column)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                valid = (ids >= 0) & (ids < len(by_id))
                valid[valid] = exists[ids[valid]]
                counts = np.concatenate(([0], np.cumsum(valid)))
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                bounds = counts[np.concatenate(([0], np.cumsum(lengths)))]
                spelled = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), tokens.take(pa.array(ids[valid])))
                texts = pc.binary_join(spelled, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, as_column])

    kept = encoded.drop(as_column)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(as_column, T.StringType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ``decode(encode(...))``."""

    def sha(text: Column) -> Column:
        return F.sha2(text, 256)

    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )
