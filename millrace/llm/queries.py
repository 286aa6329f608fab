"""The numbered queries: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import base64

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, line_dedup, lm_score, mixing, near_dedup, packing, phrases, pii, quality, reshard, vector_codes
from .common import table

#: Shards of the present layout and of the new one.
OLD_SHARDS = NEW_SHARDS = 8


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact duplicates of ``documents`` through the cuckoo-filter index."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def vocabulary() -> str:
    """The JSON of the word-level vocabulary; its place is the installed package's matter."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again."""
    names = vocabulary()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, folder, "documents"), names), names))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` without the lines whose template an earlier document has."""
    left = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return left.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of ``documents`` at a similarity of 0.85."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of ``documents`` and the terms that reveal it."""
    return pii.digests(pii.find(table(spark, folder, "documents")))


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` scored by a model of nine tenths of them."""
    docs = table(spark, folder, "documents")
    scored = lm_score.score(docs).withColumn("held_out", lm_score.held_out())
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_reshard(spark: SparkSession, folder: str) -> DataFrame:
    """From one shard per source group, which are very unequal, to eight of equal size."""
    docs = table(spark, folder, "documents")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(OLD_SHARDS))
    return reshard.reshard(docs, old, OLD_SHARDS, NEW_SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` judged by what the co-trained views learn from ``labels``."""
    docs = table(spark, folder, "documents")
    judged = quality.classify(docs, quality.train(docs, table(spark, folder, "labels")))
    return judged.select(
        "doc_id",
        F.col("_p_text").alias("p_text"),
        F.col("_p_metadata").alias("p_metadata"),
        F.col("_p_bad").alias("p_bad"),
        F.col("_kept").alias("kept"),
    )


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest ``embeddings`` of every hundredth one."""
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` repeated to shares that grow with the square root of a source's size."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.withColumnsRenamed({"_copy": "copy", "_spot": "spot"})


def byte_vocabulary() -> tuple[str, dict[bytes, int], str]:
    """The byte-level vocabulary as JSON and as ranks, and its way to split."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        names = file.read()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        pairs = [line.split() for line in file]
    return names, {base64.b64decode(token): int(rank) for token, rank in pairs}, public_tokenizers.PATTERN


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of ``documents`` in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), *byte_vocabulary())


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest collocations of each language of ``documents``."""
    return phrases.collocations(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as four entry numbers each."""
    return vector_codes.coded(table(spark, folder, "embeddings"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM k
"""

OP10_SQL = """
WITH RECURSIVE s AS (
  SELECT coalesce(source, '') AS source, sum(length(coalesce(text, '')))::BIGINT AS size
  FROM documents GROUP BY 1),
t AS (SELECT sum(size)::DOUBLE AS all_size, sum(pow(size::DOUBLE, 0.5)) AS all_raw FROM s),
r AS (
  SELECT source, CASE WHEN size > 0
         THEN round(pow(size::DOUBLE, 0.5) / all_raw * all_size / size, 9) ELSE 0 END AS rate
  FROM s, t),
p AS (
  SELECT source, rate, 0 AS k, -rate AS log_p, exp(-rate) AS cdf FROM r WHERE rate > 0
  UNION ALL
  SELECT source, rate, k + 1, log_p + ln(rate) - ln(k + 1), cdf + exp(log_p + ln(rate) - ln(k + 1))
  FROM p WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
c AS (
  SELECT d.*, unnest(range((
    SELECT count(*) FROM p WHERE p.source = coalesce(d.source, '') AND p.cdf <=
      ('0x' || substr(md5('copies-17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0)
  ))::INT AS copy
  FROM documents d)
SELECT *, ('0x' || substr(md5('order-17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR), 1, 13))::BIGINT
  / 4503599627370496.0 AS spot
FROM c
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM p
  UNION ALL
  SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) FROM p WHERE len(w) > 1
  UNION ALL
  SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))
  FROM p WHERE len(w) > 2),
f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS n, string_split(phrase, ' ') AS w
  FROM g GROUP BY lang, words, phrase HAVING count(*) >= 10),
s AS (SELECT lang, count(*) AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (
  SELECT lang, phrase, words, n AS a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, c.k, x.n AS l, y.n AS r,
    (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, inside, max(n) AS f
  FROM (SELECT lang, n, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inside FROM f WHERE words = 3)
  GROUP BY lang, inside),
ranked AS (
  SELECT lowest.lang, phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND inside = phrase
  WHERE f IS NULL OR 100 * f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN s USING (lang) WHERE rank <= 2000
"""

def op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other, every part compared with all entries."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
d{t} AS (
  SELECT x.part, x.vec_id, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d
  FROM x JOIN c{t} c ON c.part = x.part AND c.place = x.place GROUP BY ALL),
a{t} AS MATERIALIZED (SELECT part, vec_id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{t} GROUP BY part, vec_id)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (
  SELECT x.part, a.entry, x.place, floor(sum(x.v)::DOUBLE / count(*))::HUGEINT AS v
  FROM x JOIN a{t} a ON a.part = x.part AND a.vec_id = x.vec_id GROUP BY ALL),
c{t + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.place, coalesce(m.v, c.v) AS v
  FROM c{t} c LEFT JOIN m{t} m ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, embedding AS e, len(embedding) // 4 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, i // w AS part, i % w AS place, floor(e[i + 1]::DOUBLE * 1024)::HUGEINT AS v
  FROM (SELECT *, unnest(range(len(e))) AS i FROM k)),
c0 AS MATERIALIZED (
  SELECT x.part, n AS entry, x.place, x.v
  FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM k) USING (vec_id) WHERE n < 256),
{",".join(steps)},
r AS (
  SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN k USING (vec_id)
"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_line_dedup, op4_near_dedup, op5_pii, op6_lm_score, op7_reshard, op8_quality, op9_nearest, op10_mixing, op11_packing, op12_phrases, op13_vector_codes)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op10_mixing": OP10_SQL, "op12_phrases": OP12_SQL, "op13_vector_codes": op13_sql()}
