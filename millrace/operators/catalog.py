"""Catalog operators: engine flags (P28), engine names (P27), joins (J2, F9), rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the catalog's marker for "not available on this engine".
NOT_AVAILABLE = "NA"
ENGINES = ("ollama", "vllm")


def available(name: Column) -> Column:
    return ~F.coalesce(name, F.lit("")).isin("", NOT_AVAILABLE)


def with_engines(catalog: DataFrame) -> DataFrame:
    """Adds ``engines``: the engines an entry can run on."""
    return catalog.withColumn(
        "engines",
        F.array_compact(
            F.array(
                F.when(available(F.col("name")), "ollama"),
                F.when(available(F.col("hf_name")), "vllm"),
            )
        ),
    )


def engine_name(engine: Column, name: Column, hf_name: Column) -> Column:
    return F.when(engine == "vllm", hf_name).otherwise(name)


def join_catalog(
    requests: DataFrame, catalog: DataFrame, model_key: str = "model_key", engine: str = "engine",
    small: bool = False,
) -> DataFrame:
    """Request rows with their catalog entry; adds ``engine_model`` and ``reject_reason``.

    ``small`` says the caller has checked the catalog's row count against
    ``sources.catalog.MAX_BROADCAST_ROWS``; it is then broadcast.
    """
    side = catalog.select(
        F.col("key").alias(model_key), "name", "hf_name",
        *[c for c in ("temperature", "max_tokens", "top_p", "stop_sequences") if c in catalog.columns],
        F.lit(True).alias("_known"),
    )
    joined = requests.join(F.broadcast(side) if small else side, model_key, "left")
    chosen = engine_name(F.col(engine), F.col("name"), F.col("hf_name"))
    usable = F.coalesce(chosen, F.lit(NOT_AVAILABLE)) != NOT_AVAILABLE
    reason = (
        F.when(F.col("_known").isNull(), "unknown model")
        .when(~F.col(engine).isin(*ENGINES), "unknown engine")
        .when(~usable, "not available for engine")
    )
    return joined.withColumn("reject_reason", reason).withColumn(
        "engine_model", F.when(reason.isNull(), chosen)
    ).drop("_known")


def _ordered(pair: Column) -> Column:
    return (F.size(pair) == 2) & (F.element_at(pair, 1) <= F.element_at(pair, 2))


def quality_rules() -> dict[str, Column]:
    """Range and format rules over catalog columns; a NULL member passes its rule."""
    c = F.col
    span = c("temperature_range")
    return {
        "temperature in [0,1]": c("temperature").between(0.0, 1.0),
        "top_p in [0,1]": c("top_p").between(0.0, 1.0),
        "max_tokens >= 1": c("max_tokens") >= 1,
        "top_k >= 0": c("top_k") >= 0,
        "gpu_memory format": c("gpu_memory").rlike(r"^\d+GB$"),
        "cuda_version format": c("cuda_version").rlike(r"^>=\d+\.\d+$"),
        "gpu_memory_utilization in [0,1]": c("gpu_memory_utilization").between(0.0, 1.0),
        # only the first alternative is anchored at the start, only the second at the end
        "engine": c("engine").rlike(r"^ollama|vllm$"),
        "temperature_range": _ordered(span) & (F.element_at(span, 1) >= 0.0) & (F.element_at(span, 2) <= 1.0),
        "batch_size_range": _ordered(c("batch_size_range")),
        "concurrent_range": _ordered(c("concurrent_range")),
        "max_tokens_limit >= 1": c("max_tokens_limit") >= 1,
    }


_RULE_COLUMNS = {
    "temperature in [0,1]": "temperature",
    "top_p in [0,1]": "top_p",
    "max_tokens >= 1": "max_tokens",
    "top_k >= 0": "top_k",
    "gpu_memory format": "gpu_memory",
    "cuda_version format": "cuda_version",
    "gpu_memory_utilization in [0,1]": "gpu_memory_utilization",
    "engine": "engine",
    "temperature_range": "temperature_range",
    "batch_size_range": "batch_size_range",
    "concurrent_range": "concurrent_range",
    "max_tokens_limit >= 1": "max_tokens_limit",
}


def check_quality(catalog: DataFrame) -> DataFrame:
    """Adds ``violations`` (rules an entry breaks) and ``valid``, for the columns present.

    ``resources`` and ``requirements`` maps are opened for the rules that look inside them.
    """
    df = catalog
    if "resources" in df.columns:
        df = df.withColumn("gpu_memory", F.col("resources")["gpu_memory"])
    if "requirements" in df.columns:
        df = df.withColumn("cuda_version", F.col("requirements")["cuda_version"]).withColumn(
            "gpu_memory_utilization", F.col("requirements")["gpu_memory_utilization"].try_cast("double")
        )
    rules = {n: r for n, r in quality_rules().items() if _RULE_COLUMNS[n] in df.columns}
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()])
    )
    return df.withColumn("violations", broken).withColumn("valid", F.size("violations") == 0)
