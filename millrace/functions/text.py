"""Text helpers: Python-compatible trimming, decoding, rendering of scalars."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """``str.strip()`` (Spark's ``trim`` only removes spaces)."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def _decoded(encoding: str):
    @F.pandas_udf(T.StringType())
    def decode(content: pd.Series) -> pd.Series:
        def one(raw):
            if raw is None:
                return None
            try:
                return raw.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
            except UnicodeDecodeError:
                return raw.decode(encoding, errors="replace")

        return pd.Series([one(c) for c in content], dtype=object)

    return decode


def decode_text(content: Column, encoding: str = "utf-8") -> Column:
    """Bytes to text.

    Valid input gets universal newlines; input with broken sequences keeps its line ends and
    has each broken sequence replaced by U+FFFD. Encodings other than UTF-8 are decoded in Arrow batches,
    since the built-in function fails on a broken sequence.
    """
    if codecs.lookup(encoding).name != "utf-8":  # an unknown name fails here, before any job
        return _decoded(encoding)(content)
    text = content.cast("string")
    return F.when(
        F.is_valid_utf8(text), F.regexp_replace(text, "\r\n?", "\n")
    ).otherwise(F.make_valid_utf8(text))


def float_text(col: Column) -> Column:
    """A double the way Python prints it.

    Python switches to exponents below 1e-4 and from 1e16 on, Java below 1e-3 and from 1e7 on.
    """
    java = col.cast("string")
    size = F.abs(col)
    fixed = F.regexp_replace(
        F.regexp_replace(java.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    power = F.substring_index(java, "E", -1).cast("int")
    exponent = F.concat(
        mantissa,
        F.lit("e"),
        F.when(power < 0, "-").otherwise("+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when(F.isnan(col), "nan")
        .when(size == float("inf"), F.when(col > 0, "inf").otherwise("-inf"))
        .when(~F.contains(java, F.lit("E")), java)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        # "10" digits of padding only matter below 100; longer powers keep their own width
        .when(F.abs(power) >= 100, F.concat(
            mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string")))
        .otherwise(exponent)
    )


def scalar_text(col: Column, dtype: T.DataType, null_text: str = "nan") -> Column:
    """``str(value)`` for a typed cell (X1); a missing cell prints as ``null_text``."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, "True").otherwise("False")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(col)
    else:
        text = col.cast("string")
    return F.when(col.isNull(), F.lit(null_text)).otherwise(text)
