"""Canonical JSON text, byte for byte as Python's json.dumps(sort_keys=True) writes it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _float_repr(value: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else json.dumps(float(v)) for v in value], dtype=object)


def json_float(value: Column) -> Column:
    """Python float text: the shortest digits that round-trip.

    Numbers Python writes without an exponent are formatted natively; only others go to Python.
    """
    value = value.cast("double")
    positional = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    shown = None
    for digits_after_point in (16, 15, 14):
        attempt = F.format_string(f"%.{digits_after_point}e", F.abs(value))
        kept = F.when(attempt.try_cast("double") == F.abs(value), attempt)
        shown = attempt if shown is None else F.coalesce(kept, shown)
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(shown, r"^([\d.]+)e", 1), r"\.", ""), "0+$", "")
    power = F.regexp_extract(shown, r"e\+?(-?\d+)$", 1).try_cast("int")
    count, point = F.length(digits), power + 1
    below_one = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0"))
    fraction = F.when(count > point, F.substring(digits, point + 1, count)).otherwise("0")
    native = F.concat(
        F.when(value < 0, "-").otherwise(""),
        F.when(power < 0, below_one).otherwise(F.concat(whole, F.lit("."), fraction)),
    )
    return F.when(positional, native).otherwise(_float_repr(F.when(~positional, value)))


def json_string(text: Column) -> Column:
    """Quoted ASCII-only JSON string; other characters become \\uXXXX per UTF-16 unit."""
    characters = F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1))

    def escape(character: Column) -> Column:
        units = F.lower(F.hex(F.encode(character, "UTF-16BE")))
        return (
            F.when(character == '"', '\\"')
            .when(character == "\\", "\\\\")
            .when(character == "\b", "\\b")
            .when(character == "\t", "\\t")
            .when(character == "\n", "\\n")
            .when(character == "\f", "\\f")
            .when(character == "\r", "\\r")
            .when(character.between(" ", "~"), character)
            .otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
        )

    escaped = F.concat_ws("", F.transform(characters, escape))
    plain = ~text.rlike(r'[^\x20-\x7e]|["\\]')
    body = F.when(plain, text).otherwise(escaped)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_object(**fields: Column) -> Column:
    """Object text from already encoded member columns, keys sorted."""
    parts: list[Column] = []
    for index, key in enumerate(sorted(fields)):
        parts.append(F.lit(("" if index == 0 else ", ") + json.dumps(key) + ": "))
        parts.append(fields[key])
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def short_id(canonical: Column) -> Column:
    """First 12 hex characters of the SHA-256 of the text."""
    return F.left(F.sha2(canonical, 256), F.lit(12))
