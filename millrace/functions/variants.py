"""Helpers around VARIANT values and MAP<STRING, VARIANT> objects.

Request bodies are maps of variants because *key present* and *value not null* are different
facts: a JSON null is a present key whose value is a variant null.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT = "map<string,variant>"
LIST = "array<variant>"


def literal(value: Any) -> Column:
    """A driver-side Python value as a variant constant."""
    return F.parse_json(F.lit(json.dumps(value)))


def literal_object(values: dict[str, Any]) -> Column:
    """A driver-side dict as MAP<STRING, VARIANT>, key order kept."""
    if not values:
        return F.from_json(F.lit("{}"), OBJECT)
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), literal(v))])


def parse_object(text: Column) -> Column:
    """JSON object text to a map; NULL for anything else. A repeated key keeps its last value."""
    return F.map_concat(F.from_json(text, OBJECT))


def as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT)


def as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", LIST)


# Leading word of a variant's schema text, and the JSON kind it stands for.
_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "VOID": "null",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A constant map probed once; every operand here is evaluated a single time per row."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def kind(value: Column) -> Column:
    """object | array | string | number | boolean | null, and SQL NULL for a missing value."""
    schema = F.schema_of_variant(value)
    return _lookup(_KINDS, F.substring_index(F.substring_index(schema, "<", 1), "(", 1))


def is_object(value: Column) -> Column:
    """Whether a value is a JSON object, without a look at its members."""
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()


def truthy(value: Column) -> Column:
    """Python truth of a JSON value; a missing value is false."""
    empty = ("null", "false", '""', "[]", "{}", "0", "0.0", "-0", "-0.0")
    return ~F.coalesce(F.to_json(value), F.lit("null")).isin(*empty)


def value_text(value: Column) -> Column:
    """``str(value)`` for a scalar JSON value; containers give their JSON text."""
    python = {"null": "None", "true": "True", "false": "False"}
    return F.when(kind(value).isin("null", "boolean"), _lookup(python, F.to_json(value))).otherwise(
        value.cast("string")
    )


def string_or_null(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(kind(value) == "string", value.cast("string"))


def number_or_null(value: Column, dtype: str = "double") -> Column:
    """The value if it is a JSON number (F12), else NULL. Digits inside strings do not count, a
    boolean counts as 0 or 1."""
    return F.when(kind(value).isin("number", "boolean"), F.try_variant_get(value, "$", dtype))


@F.pandas_udf(T.StringType())
def python_json_text(raw: pd.Series, mode: pd.Series) -> pd.Series:
    """JSON text laid out as Python writes it: ``dumps`` spacing and escapes, or ``str()``.

    Rows that do not need it come in as NULL and pass through.
    """

    def one(text, how):
        if text is None:
            return None
        value = json.loads(text)
        return json.dumps(value) if how == "dumps" else str(value)

    return pd.Series([one(t, m) for t, m in zip(raw, mode)], dtype=object)


def is_json(text: Column) -> Column:
    """Exact JSON validity, NULL for NULL; trailing content, which the parsers ignore, is found too.

    Content behind a value can close one of two wrappers, an array or an object, but never both.
    """
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    valid = F.coalesce((F.size(in_array) == 1) & in_object.isNotNull(), F.lit(False))
    return F.when(text.isNotNull(), valid)
