"""Language-model scores by prediction by partial matching over bytes.

Counts of the six symbols that end at every byte of the training texts are gathered over the whole
corpus; all shorter contexts are sums of them. The trie holds, for each order from 5 down to 0,
the symbols seen after each context. A symbol is coded in the longest context that was seen; if it
was not seen there, an escape (method C: as likely as the number of distinct symbols) leads to the
next shorter context, where the symbols of the longer one are excluded. Below order 0 all symbols
left are equally likely. Every text ends with a symbol of its own, so the scores are probabilities of whole texts.

The trie is a set of tables, one of the nodes of each order, and no node is left out at any size of the corpus.
The probabilities of the most frequent nodes are sent to the tasks; the distinct grams of the texts that
are not among them are looked up by joins, order by order, and summed per text.
A caller may prune instead: nodes below a share of all training symbols are dropped, the rest is sent
as a whole, and pruned symbols are reached by escapes, whose estimate grows by their count.

The word baseline needs the counts of all words. The frequent ones are sent to the tasks, the
rest of each text is joined with the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, string_column, text_of, text_slices, utf8_buffer

ORDER = 5
#: Codes: 256 bytes and the end of a text, which also stands before its start.
END, SYMBOLS, BITS = 256, 257, 9
MASK = (1 << BITS) - 1
#: Grams whose probabilities are sent to the tasks, at most.
HEAD_GRAMS = 1 << 21
#: Words whose counts are sent to the tasks, at most.
HEAD_WORDS = 1 << 18
#: Rows one task gathers before it passes them on.
GATHERED = 1 << 20
SMOOTHING = 0.1


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the lower-cased words in order, the distinct words, and the n + 1 bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    keep = filled[codes] if len(codes) else np.empty(0, bool)
    counts = np.concatenate(([0], np.cumsum(keep)))
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return codes[keep], coded.dictionary, counts[np.concatenate(([0], np.cumsum(lengths)))]


def grams_of(codes: np.ndarray, distinct: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts packed with the ``ORDER`` before it, and the n + 1 bounds.

    A text is its words with one space between, and an end.
    """
    words = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), distinct.take(pa.array(codes)))
    raw, starts = utf8_buffer(pc.binary_join(words, pa.scalar(" ", pa.large_string())))
    n = len(bounds) - 1
    lengths = np.diff(starts)
    # ORDER ends before each text keep its first contexts apart from the text before
    symbols = np.full(len(raw) + n * (ORDER + 1), END, np.int64)
    owner = np.repeat(np.arange(n), lengths)
    symbols[np.arange(len(raw)) + owner * (ORDER + 1) + ORDER] = raw
    packed = symbols.copy()
    for k in range(1, ORDER + 1):
        packed[k:] |= symbols[:-k] << (BITS * k)
    real = np.ones(len(symbols), bool)
    first = starts[:-1] + np.arange(n) * (ORDER + 1)
    real[(first[:, None] + np.arange(ORDER)).ravel()] = False
    return packed[real], starts + np.arange(n + 1)


def _combined(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (with gram null) and of packed symbols (with word null)."""
    words: Counter[str] = Counter()
    keys: list[np.ndarray] = [np.empty(0, np.int64)]
    counts: list[np.ndarray] = [np.empty(0, np.int64)]

    def out(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [
            pa.concat_arrays([pa.array(list(words), pa.string()), pa.nulls(len(grams), pa.string())]),
            pa.concat_arrays([pa.nulls(len(words), pa.int64()), pa.array(grams, pa.int64())]),
            pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(n, pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["word", "gram", "n"])

    for batch in batches:
        for _, texts in text_slices(string_column(batch, "text")):
            codes, distinct, bounds = words_of(texts)
            for word, n in zip(distinct.to_pylist(), np.bincount(codes, minlength=len(distinct)).tolist()):
                if n:
                    words[word] += n
            grams = pc.value_counts(pa.array(grams_of(codes, distinct, bounds)[0]))
            keys.append(grams.field("values").to_numpy())
            counts.append(grams.field("counts").to_numpy())
            if sum(map(len, keys)) > 2 * GATHERED:
                merged, n = _combined(keys, counts)
                keys, counts = [merged], [n]
            if len(words) + len(keys[0]) > GATHERED:
                yield out(*_combined(keys, counts))
                words.clear()
                keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    yield out(*_combined(keys, counts))


class Trie:
    """The nodes of each order as sorted arrays, and the log10 probabilities of escapes between orders."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], total: float | None = None):
        """``nodes[j]``: the packed contexts-and-symbols of order j in ascending order, and their counts.

        ``total`` is the number of training symbols, pruned ones included.
        """
        self.keys = [k for k, _ in nodes]
        counts = [n.astype(float) for _, n in nodes]
        self.log_count = [np.log10(n) for n in counts]
        self.contexts, first, totals, kinds = [], [], [], []
        for k, n in zip(self.keys, counts):
            contexts, at, d = np.unique(k >> BITS, return_index=True, return_counts=True)
            self.contexts.append(contexts)
            first.append(at)
            totals.append(np.add.reduceat(n, at) if len(n) else n)
            kinds.append(d.astype(float))
        self.left = SYMBOLS - (kinds[0][0] if len(kinds[0]) else 0)
        # occurrences of a context whose symbol was pruned: the context is itself a node one order below
        pruned = [np.maximum(0, (total or 0) - totals[0])]
        for j in range(1, len(nodes)):
            at, found = self._find(self.keys[j - 1], self.contexts[j])
            every = np.where(found, counts[j - 1][at] if len(counts[j - 1]) else 0, totals[j])
            pruned.append(np.maximum(0, every - totals[j]))
        with np.errstate(divide="ignore"):
            # reached from above by no escape: the context is the longest seen
            self.fresh = [self._levels(t, d, r, j) for j, (t, d, r) in enumerate(zip(totals, kinds, pruned))]
            # reached by an escape from each context one longer, whose symbols are excluded
            self.below = [None]
            for j in range(1, len(nodes)):
                lower = np.searchsorted(self.contexts[j - 1], self._suffix(self.contexts[j], j - 1))
                known = np.searchsorted(self.keys[j - 1], self._suffix(self.keys[j], j))
                excluded = np.add.reduceat(counts[j - 1][known], first[j]) if len(known) else counts[j]
                self.below.append(
                    self._levels(
                        totals[j - 1][lower] - excluded, kinds[j - 1][lower] - kinds[j], pruned[j - 1][lower], j - 1
                    )
                )

    def _levels(
        self, total: np.ndarray, kinds: np.ndarray, pruned: np.ndarray, order: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """log10 of what counts are divided by, and of the escape, where symbols may be excluded."""
        escape = kinds + pruned if order or self.left else np.zeros_like(kinds)
        whole = total + escape
        empty = whole == 0  # every symbol is excluded: nothing is coded here
        return np.log10(np.where(empty, 1, whole)), np.where(empty, 0, np.log10(escape) - np.log10(np.where(empty, 1, whole)))

    @staticmethod
    def _suffix(packed: np.ndarray, symbols: int) -> np.ndarray:
        return packed & ((1 << (BITS * symbols)) - 1)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        at[at == len(table)] = 0
        return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P(last symbol | the ones before it) of each packed gram."""
        result = np.zeros(len(grams))
        todo = np.arange(len(grams))
        # the context one longer in which the symbol was not found, or -1 if it was never seen
        above = np.full(len(grams), -1)
        for j in range(len(self.keys) - 1, -1, -1):
            gram = self._suffix(grams[todo], j + 1)
            at, seen = self._find(self.contexts[j], gram >> BITS)
            divisor, escape = np.zeros(len(todo)), np.zeros(len(todo))
            came = above[todo]
            new = (came < 0) & seen
            divisor[new], escape[new] = (x[at[new]] for x in self.fresh[j])
            if j + 1 < len(self.keys):
                old = came >= 0
                divisor[old], escape[old] = (x[came[old]] for x in self.below[j + 1])
            node, coded = self._find(self.keys[j], gram)
            result[todo[coded]] += self.log_count[j][node[coded]] - divisor[coded]
            result[todo[~coded]] += escape[~coded]
            above[todo] = np.where(seen, at, -1)
            todo = todo[~coded]
        result[todo] -= np.log10(max(self.left, 1))
        return result


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is left out of the training: the checksum of its id ends in 0."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 10 == 0


def counts_of(docs: DataFrame, training: Column, text_column: str = "text") -> DataFrame:
    """word, gram, n: the counts of all words and all packed symbols of the training texts, stored."""
    return store(
        docs.filter(training)
        .select(F.col(text_column).alias("text"))
        .mapInArrow(_gather, "word string, gram long, n long")
        .groupBy("word", "gram")
        .agg(F.sum("n").alias("n")),
        "counts",
    )


def fit(counts: DataFrame, min_share: float) -> Trie:
    """The trie of the nodes that reach ``min_share`` of the training symbols; its inverse bounds those of an order."""
    grams = counts.filter("gram is not null")
    total = float(grams.agg(F.sum("n")).first()[0] or 0)
    least = max(1.0, total * min_share)
    orders = F.array(
        *(
            F.struct(F.lit(j).alias("j"), F.col("gram").bitwiseAND((1 << (BITS * (j + 1))) - 1).alias("key"))
            for j in range(ORDER + 1)
        )
    )
    nodes = (
        grams.select(F.explode(orders).alias("o"), "n")
        .groupBy("o.j", "o.key")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)  # at most 1 / min_share rows an order
        .toArrow()
    )
    order, key, n = (nodes.column(c).to_numpy() for c in ("j", "key", "n"))
    sort = np.lexsort((key, order))
    order, key, n = order[sort], key[sort], n[sort]
    return Trie([(key[order == j], n[order == j]) for j in range(ORDER + 1)], total)


def _head(counted: DataFrame, limit: int) -> DataFrame:
    """The rows above the count ``n`` at which no more than ``limit`` remain."""
    step = F.floor(F.log2("n") * 20).cast("int")
    total, least = 0, None
    for row in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += row["k"]
        if total > limit:
            break
        least = row["step"]
    return counted.filter(F.lit(False) if least is None else step >= least)


def known_grams(counts: DataFrame) -> DataFrame:
    """gram, n, log_p of every gram of the training texts: each is coded in its longest context. Stored."""
    grams = counts.filter("gram is not null").select("gram", "n", F.shiftright("gram", BITS).alias("context"))
    contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    log_p = F.log10("n") - F.log10(F.col("total") + F.col("kinds"))
    return store(grams.join(contexts, "context").select("gram", "n", log_p.alias("log_p")), "known")


def _last(gram: str, symbols: int) -> Column:
    return F.col(gram).bitwiseAND((1 << (BITS * symbols)) - 1)


def unseen_grams(known: DataFrame, unseen: DataFrame) -> DataFrame:
    """gram, log_p of distinct grams that the training texts do not have, by escapes through all nodes."""
    nodes = [known.select(F.col("gram").alias("key"), "n")]
    for j in range(ORDER - 1, -1, -1):
        nodes.insert(0, store(nodes[0].groupBy(_last("key", j + 1).alias("key")).agg(F.sum("n").alias("n")), "nodes"))
    left = SYMBOLS - nodes[0].count()
    done = []
    # without: the occurrences and the number of the symbols excluded by the context one longer
    todo = unseen.select("gram", *(F.lit(0).cast(t).alias(c) for c, t in (("log_p", "double"), ("without", "long"), ("without_kinds", "long"))))
    for j in range(ORDER, -1, -1):
        todo = todo.withColumn("key", _last("gram", j + 1)).withColumn("context", F.shiftright("key", BITS))
        inside = nodes[j].withColumn("context", F.shiftright("key", BITS)).join(todo.select("context").distinct(), "context", "left_semi")
        if j:
            shorter = nodes[j - 1].select(F.col("key").alias("short"), F.col("n").alias("n_short"))
            inside = inside.withColumn("short", _last("key", j)).join(shorter, "short")
        else:
            inside = inside.withColumn("n_short", F.lit(0))
        contexts = inside.groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n_short").alias("n_short")
        )
        own = nodes[j]
        if j < 2:  # at most SYMBOLS ** 2 rows, which all grams ask for
            contexts, own = F.broadcast(contexts), F.broadcast(own)
        escape = F.col("kinds") - F.col("without_kinds") if j or left else F.lit(0)
        whole = F.col("total") - F.col("without") + escape
        step = (
            F.when(F.col("total").isNull() | (whole == 0), F.lit(0.0))
            .when(F.col("n").isNotNull(), F.log10("n") - F.log10(whole))
            .otherwise(F.log10(escape) - F.log10(whole))
        )
        met = store(
            todo.join(contexts, "context", "left")
            .join(own, "key", "left")
            .select(
                "gram",
                (F.col("log_p") + step).alias("log_p"),
                F.coalesce("n_short", F.lit(0)).cast("long").alias("without"),
                F.coalesce("kinds", F.lit(0)).cast("long").alias("without_kinds"),
                F.col("n").isNotNull().alias("found"),
            ),
            "met",
        )
        done.append(met.filter("found").select("gram", "log_p"))
        todo = met.filter("not found").drop("found")
    result = todo.select("gram", (F.col("log_p") - F.lit(float(np.log10(max(left, 1))))).alias("log_p"))
    for part in done:
        result = result.union(part)
    return result


class Head:
    """The probabilities of the most frequent grams."""

    def __init__(self, known: pa.Table):
        grams = known.column("gram").to_numpy()
        sort = np.argsort(grams)
        self.grams, self.log_p = grams[sort], known.column("log_p").to_numpy()[sort]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 P of each gram; NaN for those to be looked up."""
        at, found = Trie._find(self.grams, grams)
        return np.where(found, self.log_p[at] if len(self.grams) else 0, np.nan)


def score(
    docs: DataFrame,
    training: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    head_words: int = HEAD_WORDS,
    min_share: float | None = None,
    head_grams: int = HEAD_GRAMS,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``score`` is log10 P of the text's words with one space between and an end, lower-cased in A-Z,
    under the trie of the training rows (by default those whose id's checksum does not end in 0);
    ``base_score`` is that of the words and the end under the smoothed word counts. A null or blank
    text is an end alone. Without training rows every symbol and word is unseen. Repeated rows
    count and are scored each; an empty table gives no rows. Only the two named columns are read.
    All nodes count unless ``min_share`` is given: then only those with that share of the training
    symbols. ``head_words`` and ``head_grams`` bound what is sent to the tasks and change no result.
    """
    training = ~held_out(id_column) if training is None else training
    counts = counts_of(docs, training, text_column)
    words = counts.filter("word is not null").select("word", "n")
    ends = docs.filter(training).count()
    tally = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    total, kinds = (tally["n"] or 0) + ends, tally["kinds"] + (ends > 0)
    below = float(np.log10(total + SMOOTHING * (kinds + 1)))
    end = (float(np.log10(ends + SMOOTHING)), int(ends > 0))
    known = known_grams(counts) if min_share is None else None
    model = fit(counts, min_share) if known is None else Head(_head(known, head_grams).select("gram", "log_p").toArrow())
    sent = docs.sparkSession.sparkContext.broadcast(
        (model, {r["word"]: r["n"] for r in _head(words, head_words).select("word", "n").collect()})
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = sent.value
        for batch in batches:
            for start, texts in text_slices(string_column(batch, "text")):
                yield _score(texts, batch.slice(start, len(texts)), model, head, end)

    schema = (
        "doc_id long, row long, n_tokens long, n_head long, head_sum double, score double, "
        "rest array<struct<word:string,n:long>>, grams array<struct<gram:long,n:long>>"
    )
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_column).alias("text"),
    )
    scored = store(rows.mapInArrow(run, schema), "scored")
    rest = (
        scored.select("row", F.explode("rest").alias("r"))
        .select("row", "r.word", F.col("r.n").alias("times"))
        .join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("rest_sum"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rest"),
        )
    )
    score = F.col("score")
    if known is not None:
        looked_up = scored.select("row", F.explode("grams").alias("g")).select("row", "g.gram", F.col("g.n").alias("times"))
        asked = store(looked_up.select("gram").distinct().join(known.select("gram", "log_p"), "gram", "left"), "asked")
        log_p = asked.filter("log_p is not null")
        unseen = asked.filter("log_p is null").select("gram")
        if not unseen.isEmpty():
            log_p = log_p.union(unseen_grams(known, unseen))
        sums = looked_up.join(log_p, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("gram_sum"))
        scored = scored.join(sums, "row", "left")
        score = score + F.coalesce("gram_sum", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        score.alias("score"),
    )


def _lists(owner: np.ndarray, codes: np.ndarray, n_texts: int, kinds: int) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The bounds of each text's distinct codes, these codes, and how often each stands in it."""
    pairs, times = np.unique(owner * np.int64(max(kinds, 1)) + codes, return_counts=True)
    bounds = np.searchsorted(pairs, np.arange(n_texts + 1) * np.int64(max(kinds, 1)))
    return pa.array(bounds, pa.int32()), pairs % max(kinds, 1), pa.array(times, pa.int64())


def _score(
    texts: pa.Array, rows: pa.RecordBatch, model: Trie | Head, head: dict[str, int], end: tuple[float, int]
) -> pa.RecordBatch:
    codes, distinct, bounds = words_of(texts)
    grams, starts = grams_of(codes, distinct, bounds)
    coded = pa.array(grams).dictionary_encode()
    indices, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    each = model.log10(kinds)[indices]
    absent = np.isnan(each)
    sums = np.add.reduceat(np.where(absent, 0, each), starts[:-1])  # a text has its end at least
    symbol_owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    gram_lists, gram, gram_times = _lists(symbol_owner[absent], indices[absent], len(texts), len(kinds))
    asked = pa.StructArray.from_arrays([pa.array(kinds[gram], pa.int64()), gram_times], names=["gram", "n"])
    n = np.array([head.get(w, 0) for w in distinct.to_pylist()], np.int64)
    known = np.concatenate(([0], np.cumsum(n[codes] > 0)))
    logs = np.log10(np.maximum(n, 1) + SMOOTHING) * (n > 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    head_sum = np.bincount(owner, logs[codes], minlength=len(texts)) + end[0]
    outside = n[codes] == 0
    lists, word, times = _lists(owner[outside], codes[outside], len(texts), len(n))
    rest = pa.StructArray.from_arrays([distinct.take(pa.array(word)).cast(pa.string()), times], names=["word", "n"])
    return pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id"),
            rows.column("row"),
            pa.array(np.diff(bounds) + 1, pa.int64()),
            pa.array(known[bounds[1:]] - known[bounds[:-1]] + end[1], pa.int64()),
            pa.array(head_sum),
            pa.array(sums),
            pa.ListArray.from_arrays(lists, rest),
            pa.ListArray.from_arrays(gram_lists, asked),
        ],
        names=["doc_id", "row", "n_tokens", "n_head", "head_sum", "score", "rest", "grams"],
    )
