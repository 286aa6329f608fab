"""Prompt templates compiled once on the driver into Spark expressions.

Plain ``{name}`` placeholders become a ``concat``. Format specs, conversions and attribute or
index lookups have no Spark equivalent; only those go through an Arrow UDF.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rendered:
    """Rendered text and, where rendering failed, the reason."""

    text: Column
    error: Column


class _Unrenderable(Exception):
    """The template fails for every row."""



def _fields(template: str):
    try:
        return list(string.Formatter().parse(template))
    except ValueError as exc:
        raise _Unrenderable(str(exc)) from exc


def _failed(reason: str) -> Rendered:
    return Rendered(F.lit(None).cast("string"), F.lit(reason))


def _is_plain(name: str, spec: str, conversion) -> bool:
    return not spec and not conversion and "." not in name and "[" not in name


def _python_format(template: str, names: list[str], blanks: list[str]):
    """Row formatter for templates that use Python's own format language."""

    @F.pandas_udf("text string, error string")
    def format_row(cells_json: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for text in cells_json:
            cells = {**dict.fromkeys(blanks, ""), **dict.fromkeys(names, float("nan"))}
            cells.update(json.loads(text))
            try:
                texts.append(template.format(**cells))
                errors.append(None)
            except Exception as exc:  # any failure concerns this row only
                texts.append(None)
                errors.append(f"{type(exc).__name__}: {exc}")
        return pd.DataFrame({"text": texts, "error": errors}, dtype=object)

    return format_row


def is_plain(template: str) -> bool:
    """True when the template holds nothing but ``{name}`` placeholders and text."""
    try:
        return all(n is None or _is_plain(n, s, c) for _, n, s, c in _fields(template))
    except _Unrenderable:
        return True


def message_formatter(template: str):
    """Arrow UDF applying a template with format specs to the user messages of a JSON list."""

    @F.pandas_udf("string")
    def rewrite(messages_json: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            messages = json.loads(text)
            for entry in messages:
                if entry.get("role") == "user":
                    entry["content"] = template.format(content=entry.get("content", ""))
            return json.dumps(messages)

        return pd.Series([one(t) for t in messages_json], dtype=object)

    return rewrite


def render(
    template: str,
    texts: dict[str, Column],
    values: dict[str, Column] | None = None,
    missing: str | None = None,
) -> Rendered:
    """Render ``template`` per row.

    ``texts`` holds each field as text, ``values`` the typed fields for format specs (defaults
    to the texts). ``missing`` replaces unknown names (P2); without it an unknown name fails
    every row (P3).
    """
    values = values or texts
    try:
        parsed = _fields(template)
    except _Unrenderable as exc:
        return _failed(f"ValueError: {exc}")
    pieces: list[Column] = []
    plain = True
    names: set[str] = set()
    for text, name, spec, conversion in parsed:
        if text:
            pieces.append(F.lit(text))
        if name is None:
            continue
        root = name.split(".")[0].split("[")[0]
        if not root or root.isdigit():
            return _failed("IndexError: Replacement index out of range for positional args tuple")
        if root not in texts and (missing is None or root != name):
            return _failed(f"KeyError: '{root}'")
        names.add(root)
        names.update(n for _, n, _, _ in _fields(spec or "") if n)
        if _is_plain(name, spec, conversion):
            pieces.append(texts[root] if root in texts else F.lit(missing))
        else:
            plain = False
    if plain:
        return Rendered(F.concat(F.lit(""), *pieces), F.lit(None).cast("string"))
    known = sorted(n for n in names if n in texts)
    blanks = sorted(n for n in names if n not in texts)
    cells = F.to_json(F.struct(*[values[n].alias(n) for n in known])) if known else F.lit("{}")
    out = _python_format(template, known, blanks)(cells)
    return Rendered(out["text"], out["error"])
