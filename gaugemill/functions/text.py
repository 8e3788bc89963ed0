"""Text columns: cleaning, counting, perturbing, rendering."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.settings import NEGATION_PREFIXES

# Fixed value: the characters Python's str.split() treats as whitespace.
WHITESPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Fixed value: Unicode word tokens of two or more characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Fixed value: what html.unescape() takes for a character reference.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Characters Python's repr() may have to escape beyond \n, \r, \t.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ \n\r\t]]"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape(references: pd.Series) -> pd.Series:
    return references.map(lambda found: [html.unescape(r) for r in found], na_action="ignore")


@F.pandas_udf(T.StringType())
def _repr(text: pd.Series) -> pd.Series:
    return text.map(repr, na_action="ignore")


@F.pandas_udf(T.StringType())
def _swap_neighbours(text: pd.Series, seed: pd.Series) -> pd.Series:
    def swapped(value: str, row_seed: int) -> str:
        if value is None or len(value) < 2:
            return value
        chars = list(value)
        rng = np.random.default_rng(row_seed & 0xFFFFFFFFFFFFFFFF)
        for at in rng.integers(0, len(chars) - 1, size=max(1, len(chars) // 100)):
            chars[at], chars[at + 1] = chars[at + 1], chars[at]
        return "".join(chars)

    return pd.Series([swapped(v, int(s)) for v, s in zip(text, seed)], dtype=object)


def decode_entities(text: Column) -> Column:
    """HTML5 entities decoded once. Only the references travel to Python, never the text around them."""
    found = F.when(text.contains("&"), F.regexp_extract_all(text, F.lit(f"({_REFERENCE})"), F.lit(1)))
    pieces = F.zip_with(
        F.split(text, _REFERENCE, -1), _unescape(found), lambda between, char: F.concat(between, F.coalesce(char, F.lit("")))
    )
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def clean_text(text: Column) -> Column:
    """Null becomes empty, entities are decoded, then whitespace is collapsed."""
    return collapse_whitespace(decode_entities(F.coalesce(text, F.lit(""))))


def word_count(clean: Column) -> Column:
    """Number of words in whitespace-collapsed text."""
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def perturb(text: Column, how: str, row_id: Column | None = None, seed: int = 0) -> Column:
    """One benign rewrite. ``char_swap`` is seeded per row, so partitioning does not matter."""
    if how == "whitespace":
        return collapse_whitespace(text)
    if how == "trailing_period":
        return F.concat(F.rtrim(text, F.lit(".")), F.lit("."))
    if how == "lowercase":
        return F.lower(text)
    if how == "char_swap":
        if row_id is None:
            raise ValueError("char_swap needs row_id")
        return _swap_neighbours(text, F.xxhash64(row_id, F.lit(seed)))
    raise ValueError(f"Unknown transform: {how}")


def negation_prefix(text: Column, position: Column, prefixes=NEGATION_PREFIXES) -> Column:
    """Prefix chosen by the row's 0-based position."""
    options = F.array(*[F.lit(p) for p in prefixes])
    return F.concat(F.element_at(options, (position % len(prefixes) + 1).cast("int")), text)


def python_repr(text: Column) -> Column:
    """Quoted and escaped text; rows with rare unprintable characters go to Python."""
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double_quoted = text.contains("'") & ~text.contains('"')
    native = F.when(double_quoted, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
    return F.coalesce(_repr(F.when(text.rlike(_UNPRINTABLE), text)), native)


def format_prediction(text: Column, label: Column, prob: Column, run_id: Column, version: Column) -> Column:
    """One display line per scored text."""
    sentiment = F.when(label == 1, "positive").otherwise("negative")
    return F.concat(
        F.lit("label="), label.cast("int").cast("string"), F.lit(" ("), sentiment, F.lit(") prob="),
        F.format_number(prob, 4), F.lit(" champion="), run_id, F.lit(" version="), version,
        F.lit(" | "), python_repr(text),
    )
