"""Source to request table in one call, with the reports of the conversion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import sinks
from ..operators import items as I
from ..operators import reports
from ..operators import requests as R
from ..session import configure
from ..sources import csv_rows, files, jsonl


@dataclass(frozen=True)
class Conversion:
    """Converted rows, good and bad. Lazy: each action runs the conversion again.

    Generated ids differ between evaluations, so store with :meth:`write` and go on from there.
    """

    rows: DataFrame
    is_vision: bool = False

    @property
    def requests(self) -> DataFrame:
        return self.rows.where("error IS NULL")

    @property
    def failures(self) -> DataFrame:
        return self.rows.where("error IS NOT NULL").select("seq", "error")

    def report(self) -> DataFrame:
        """One row of counts."""
        return (
            reports.vision_report(self.rows) if self.is_vision else reports.conversion_report(self.rows)
        )

    def write(self, path: str, mode: str = "errorifexists") -> None:
        sinks.write_requests(self.rows, path, mode)


def csv_to_requests(
    spark: SparkSession, path: str, *, prompt_template: str | None = None,
    prompt_column: str | None = None, system_prompt: str | None = None, model: str | None = None,
    id_column: str | None = None, api_parameters: dict[str, Any] | None = None,
    schema=None, **csv_options,
) -> Conversion:
    configure(spark)
    if not prompt_template and not prompt_column:
        raise ValueError("Either prompt_template or prompt_column must be provided")
    rows = csv_rows.read_csv_rows(spark, path, schema, **csv_options)
    return Conversion(
        R.convert_rows(
            rows, prompt_template, prompt_column, system_prompt, model, id_column, api_parameters
        )
    )


def json_to_requests(
    spark: SparkSession, paths: str | Sequence[str], *, model: str | None = None,
    id_field: str | None = None, json_key: str | None = None, prompt_template: str | None = None,
    api_parameters: dict[str, Any] | None = None, exact_text: bool = True,
) -> Conversion:
    configure(spark)
    items = jsonl.read_json_items(spark, paths, json_key)
    return Conversion(
        I.convert_items(items, model, id_field, prompt_template, api_parameters, exact_text)
    )


def directory_to_requests(
    spark: SparkSession, root: str, *, file_pattern: str = "*.*", prompt_template: str | None = None,
    system_prompt: str | None = None, model: str | None = None,
    exclude_patterns: Sequence[str] | None = None, max_file_size: int = files.DEFAULT_TEXT_LIMIT,
    encoding: str = "utf-8", extensions: Sequence[str] | None = None, recursive: bool = True,
    api_parameters: dict[str, Any] | None = None,
) -> Conversion:
    configure(spark)
    found = files.read_text_files(
        spark, root, file_pattern, extensions, exclude_patterns, recursive, max_file_size
    )
    return Conversion(
        R.convert_text_files(
            found, prompt_template, system_prompt, model, api_parameters, encoding, max_file_size
        )
    )


def vision_to_requests(
    spark: SparkSession, root: str, *, prompt_template: str | None = None,
    prompts: dict[str, str] | DataFrame | None = None, system_prompt: str | None = None,
    model: str | None = None, max_image_size: int = files.DEFAULT_IMAGE_LIMIT,
    file_pattern: str | None = None,
) -> Conversion:
    configure(spark)
    images = files.read_images(spark, root, file_pattern, max_image_size)
    return Conversion(
        R.convert_images(images, root, prompt_template, prompts, system_prompt, model, max_image_size),
        is_vision=True,
    )
