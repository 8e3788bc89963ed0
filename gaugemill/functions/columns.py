"""Typed columns of the review table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugemill.settings import NEGATIVE_RATING_CEILING, POSITIVE_RATING_FLOOR

# Cell texts that mean "missing" in a CSV file.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_if_na(text: Column) -> Column:
    return F.when(~text.isin(*NA_STRINGS), text)


def _pivot_year(date: Column) -> Column:
    """Two-digit years 69-99 belong to the 1900s."""
    return F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)


def parse_date(text: Column) -> Column:
    """Day-month-year text such as 3-Feb-12; anything else raises."""
    return _pivot_year(F.to_date(text, "d-MMM-yy")).cast("timestamp_ntz")


def try_parse_date(text: Column) -> Column:
    """As parse_date, but null for text that is no such date."""
    return _pivot_year(F.try_to_timestamp(text, F.lit("d-MMM-yy")).cast("date")).cast("timestamp_ntz")


def rating_bucket(rating: Column) -> Column:
    """low for 0 to 4, medium up to 7, high up to 10, null elsewhere."""
    return (
        F.when((rating >= 0) & (rating <= 4), "low")
        .when((rating > 4) & (rating <= 7), "medium")
        .when((rating > 7) & (rating <= 10), "high")
    )


def required(column: Column, dtype: str, name: str) -> Column:
    """Cast that raises on null as well as on overflow."""
    return F.when(column.isNull(), F.raise_error(F.lit(f"null in {name}"))).otherwise(column).cast(dtype)


def is_binary_rating(
    rating: Column, floor: int = POSITIVE_RATING_FLOOR, ceiling: int = NEGATIVE_RATING_CEILING
) -> Column:
    return (rating >= floor) | (rating <= ceiling)


def sentiment(rating: Column, floor: int = POSITIVE_RATING_FLOOR) -> Column:
    return F.when(rating >= floor, 1).otherwise(0).cast("byte")
