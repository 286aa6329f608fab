"""Benchmark prompt sets from a multi-turn dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.requests import turn_messages
from ..operators.sampling import sampled_requests, stratified_sample


def benchmark_requests(
    dataset: DataFrame, num_prompts: int = 120, model: str | None = None, temperature: float = 0.7,
    max_tokens: int = 500, id_column: str = "id", unique_ids: bool = True, seed: int = 42,
) -> DataFrame:
    """An equal share of each category as chat requests, categories in their fixed order.

    ``dataset`` has an id, ``category`` and ``turns ARRAY<STRING>``. Rows are drawn first, so
    messages are built for the drawn rows only. ``seq`` is (category position, draw rank). Without
    ``unique_ids`` every request is called ``request1``.
    """
    drawn = stratified_sample(dataset, num_prompts, "category", id_column, seed=seed)
    prompts = drawn.select(
        F.struct("category_pos", "rank").alias("seq"),
        F.concat_ws("-", "category", id_column).alias("prompt_id"),
        turn_messages(F.col("turns"), F.col("category")).alias("messages"),
    )
    key = "prompt_id" if unique_ids else None
    return sampled_requests(prompts, "messages", key, model, temperature, max_tokens)
