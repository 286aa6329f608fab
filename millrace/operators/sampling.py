"""Prompt pools and ordered chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import first_per_key, number_rows
from .requests import CATEGORIES, build_requests, chat_messages

# Wording of the synthetic prompts.
PROMPT_TEMPLATES = [
    "What is {}?",
    "Explain {} in simple terms.",
    "How does {} work?",
    "Describe the key features of {}.",
    "What are the benefits of {}?",
]
PROMPT_TOPICS = [
    "machine learning",
    "cloud computing",
    "data science",
    "artificial intelligence",
    "neural networks",
    "deep learning",
    "natural language processing",
    "computer vision",
    "reinforcement learning",
    "distributed systems",
]
SYNTHETIC_MAX_TOKENS = 512


def synthetic_prompts(
    spark: SparkSession, num_prompts: int = 50, seed: int = 42, model: str | None = "llama3.2:3b"
) -> DataFrame:
    """Seeded synthetic chat requests.

    The draw is a hash of seed and index, so it does not depend on partitioning.
    """
    i = F.col("id")

    def draw(values, salt):
        index = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(len(values))).cast("int")
        return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)

    content = F.replace(draw(PROMPT_TEMPLATES, "template"), F.lit("{}"), draw(PROMPT_TOPICS, "topic"))
    return build_requests(
        spark.range(num_prompts), chat_messages(content), model, F.format_string("bench-%04d", i),
        max_tokens=SYNTHETIC_MAX_TOKENS, seq="id",
    )


def seeded_hash(seed: int, *columns: str):
    """Hexadecimal draw order of a row, equal on every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def prompt_subset(pool: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """A seeded random subset of ``n`` rows (L2); 0 gives none, a negative ``n`` all.

    With ``n`` at or over the pool size every row qualifies, so all come back. ``draw_rank`` is the
    place in the draw, from 1.
    """
    if n == 0:
        return pool.withColumn("draw_rank", F.lit(None).cast("bigint")).where(F.lit(False))
    if n < 0:
        return pool.withColumn("draw_rank", F.lit(None).cast("bigint"))
    hashed = pool.withColumn("_hash", seeded_hash(seed, id_column))
    return first_per_key(hashed, [], "_hash", n, key_count=1).withColumnRenamed("rank", "draw_rank").drop("_hash")


def stratified_sample(
    pool: DataFrame, num_prompts: int, category: str, id_column: str,
    categories: Sequence[str] = CATEGORIES, seed: int = 42,
) -> DataFrame:
    """``num_prompts // len(categories)`` rows of each category (L3, W4); the remainder is lost.

    ``category_pos`` gives the fixed category order, ``rank`` the place inside the category. A
    negative share means whole categories, in no particular rank.
    """
    names = list(categories)
    quota = num_prompts // len(names)
    position = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(category)).cast("int")
    chosen = pool.where(F.col(category).isin(names)).withColumn("category_pos", position)
    if quota < 0:
        return chosen.withColumn("rank", F.lit(None).cast("bigint"))
    hashed = chosen.withColumn("_hash", seeded_hash(seed, id_column))
    return first_per_key(hashed, [category], "_hash", quota, key_count=len(names)).drop("_hash")


def sampled_requests(
    sample: DataFrame, messages: str, id_column: str | None,
    model: str | None = None, temperature: float = 0.7, max_tokens: int = 500,
    seq: str = "seq",
) -> DataFrame:
    """Sampled message lists as requests; ids are ``<category>-<id>`` style texts or ``request1``.

    ``messages`` is an array of role/content structs. Without an id column every request gets the
    fixed id ``request1``, so ids then repeat.
    """
    key = id_column if id_column else F.lit("request1")
    return build_requests(sample, messages, model, key, temperature, max_tokens, seq=seq)


def batch_chunks(
    df: DataFrame, order_by: str, batch_size: int = 4, save_frequency: int = 50
) -> DataFrame:
    """Exact batches over an ordered input (W1) and its save points.

    Adds ``batch_id``, ``pos_in_batch`` and ``save_point``: true on the row that completes a full
    batch at a multiple of ``save_frequency``.
    """
    n = F.col("row_number")
    done = n + 1
    return (
        number_rows(df, order_by)
        .withColumn("batch_id", F.floor(n / batch_size))
        .withColumn("pos_in_batch", n % batch_size)
        .withColumn("save_point", (done % batch_size == 0) & (done % save_frequency == 0))
        .drop("row_number", "_total")
    )
