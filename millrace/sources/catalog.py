"""Model catalog (S7): the built-in table, or a custom YAML/JSON file read on the driver."""

from __future__ import annotations

import csv
import json
import logging
from dataclasses import dataclass
from importlib import resources
from typing import Any

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# Parameters a catalog entry has when it does not set them.
DEFAULT_PARAMETERS = {"temperature": 0.7, "max_tokens": 2048, "top_p": 0.9, "top_k": 40}

CATALOG_SCHEMA = (
    "key string, name string, hf_name string, "
    "temperature double, max_tokens bigint, top_p double, top_k bigint, stop_sequences array<string>, "
    "resources map<string,string>, system_prompt string, "
    "temperature_range array<double>, max_tokens_limit bigint, batch_size_range array<bigint>, "
    "concurrent_range array<bigint>, requirements map<string,string>"
)

#: Catalog tables up to this many rows are broadcast; beyond it the planner decides.
MAX_BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class ModelSpec:
    """The model of one run."""

    key: str
    name: str | None = None
    hf_name: str | None = None
    engine: str = "vllm"
    temperature: float | None = 0.7
    max_tokens: int | None = 2048
    top_p: float | None = 0.9
    stop_sequences: tuple[str, ...] | None = None

    @property
    def engine_name(self) -> str | None:
        """The name the engine knows the model by."""
        if self.engine != "vllm":
            return self.name
        if not self.hf_name:
            raise ValueError(f"model '{self.key}' has no hf_name, which the vllm engine needs")
        return self.hf_name

    def require_available(self) -> None:
        """Raise unless the model exists for its engine."""
        if self.engine not in ("vllm", "ollama"):
            raise ValueError(f"unknown engine: {self.engine}")
        if (self.hf_name if self.engine == "vllm" else self.name) in (None, "NA"):
            raise ValueError(f"model '{self.key}' is not available for the {self.engine} engine")


def _entry(key: str, data: dict[str, Any]) -> dict[str, Any]:
    params = {**DEFAULT_PARAMETERS, **(data.get("parameters") or {})}
    ranges = data.get("validation") or {}

    def floats(values):
        return None if values is None else [float(v) for v in values]

    def texts(values):
        return None if values is None else {k: str(v) for k, v in values.items()}

    return {
        "key": key,
        "name": data.get("name"),
        "hf_name": data.get("hf_name"),
        "temperature": float(params["temperature"]),
        "max_tokens": int(params["max_tokens"]),
        "top_p": float(params["top_p"]),
        "top_k": int(params["top_k"]),
        "stop_sequences": params.get("stop_sequences"),
        "resources": texts(data.get("resources")),
        "system_prompt": (data.get("system") or {}).get("prompt"),
        "temperature_range": floats(ranges.get("temperature_range")),
        "max_tokens_limit": ranges.get("max_tokens_limit"),
        "batch_size_range": ranges.get("batch_size_range"),
        "concurrent_range": ranges.get("concurrent_range"),
        "requirements": texts(data.get("requirements")),
    }


def builtin_entries() -> list[dict[str, Any]]:
    text = resources.files(__package__).joinpath("model_catalog.csv").read_text("utf-8")
    lines = text.splitlines()[1:]  # the first line is a comment
    return [
        _entry(
            row["key"],
            {
                "name": row["name"],
                "hf_name": row["hf_name"],
                "parameters": {
                    "temperature": row["temperature"],
                    "stop_sequences": row["stop_sequences"].split(),
                },
            },
        )
        for row in csv.DictReader(lines)
    ]


def _read_mapping(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml  # only custom YAML files need it

        data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise TypeError(f"custom catalog '{path}' must hold a mapping")
    return data


def custom_entries(path: str, key: str | None = None) -> list[dict[str, Any]]:
    """Entries of a custom file in any of its three shapes.

    ``{models: {k: ...}}`` and ``{k: {...}}`` hold entries by key; a bare entry serves any key.
    """
    data = _read_mapping(path)
    if "models" in data:
        if not isinstance(data["models"], dict):
            raise TypeError(f"custom catalog '{path}' has an invalid 'models' member")
        return [_entry(k, v) for k, v in data["models"].items() if isinstance(v, dict)]
    if key is not None and not isinstance(data.get(key), dict):
        return [_entry(key, data)]
    return [_entry(k, v) for k, v in data.items() if isinstance(v, dict)]


def catalog_table(spark: SparkSession, entries: list[dict[str, Any]] | None = None) -> DataFrame:
    rows = builtin_entries() if entries is None else entries
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def load_model(key: str, engine: str = "vllm", custom_path: str | None = None) -> ModelSpec | None:
    """One model by key; an unknown key or an unusable file gives None and a warning."""
    try:
        entries = custom_entries(custom_path, key) if custom_path else builtin_entries()
        found = [e for e in entries if e["key"] == key]
        if not found:
            raise KeyError(f"model '{key}' not in catalog")
    except (OSError, KeyError, TypeError) as exc:
        log.warning("no configuration for %r: %s", key, exc)
        return None
    entry = found[0]
    stops = entry["stop_sequences"]
    return ModelSpec(
        key=key, name=entry["name"], hf_name=entry["hf_name"], engine=engine,
        temperature=entry["temperature"], max_tokens=entry["max_tokens"], top_p=entry["top_p"],
        stop_sequences=None if stops is None else tuple(stops),
    )
