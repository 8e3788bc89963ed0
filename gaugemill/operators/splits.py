"""Review-table preparation, salted splits and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.functions import columns, text
from gaugemill.functions.hashing import ab_variant, is_holdout
from gaugemill.settings import (
    INCOMING_EVAL_FRACTION,
    INCOMING_SPLIT_SALT,
    NEGATIVE_RATING_CEILING,
    POSITIVE_RATING_FLOOR,
)


def prepare_split(raw: DataFrame, label: str) -> DataFrame:
    """The twelve-column processed table of one split."""
    clean = raw.withColumn("_text", text.clean_text(F.col("review"))).withColumn(
        "_date", columns.parse_date(F.col("date"))
    )
    return clean.select(
        columns.required(F.col("uniqueID"), "int", "uniqueID").alias("unique_id"),
        F.col("drugName").cast("string").alias("drug_name"),
        F.col("condition").cast("string").alias("condition"),
        F.col("_text").alias("review_text"),
        columns.required(F.col("rating"), "smallint", "rating").alias("rating"),
        columns.rating_bucket(F.col("rating")).alias("rating_bucket"),
        F.col("_date").alias("review_date"),
        columns.required(F.year("_date"), "smallint", "date").alias("review_year"),
        columns.required(F.col("usefulCount"), "int", "usefulCount").alias("useful_count"),
        F.length("_text").alias("review_length"),
        text.word_count(F.col("_text")).alias("review_word_count"),
        F.lit(label).alias("split"),
    )


def quarantine_dates(raw: DataFrame) -> DataFrame:
    """Rows whose date text cannot be read."""
    return raw.where(F.col("date").isNotNull() & columns.try_parse_date(F.col("date")).isNull())


def assemble_splits(
    reference: DataFrame,
    current: DataFrame,
    has_incoming: bool,
    fraction: float = INCOMING_EVAL_FRACTION,
    salt: str = INCOMING_SPLIT_SALT,
) -> tuple[DataFrame, DataFrame]:
    """(training, current). A dropped file keeps its held-out share as current; the rest trains."""
    if not has_incoming:
        return reference, current
    held_out = is_holdout(F.col("unique_id"), fraction, salt)
    return reference.unionByName(current.where(~held_out)), current.where(held_out)


def combine_sort(reference: DataFrame, current: DataFrame) -> DataFrame:
    return reference.unionByName(current).orderBy("split", "review_date", "unique_id")


def sentiment_rows(
    df: DataFrame, floor: int = POSITIVE_RATING_FLOOR, ceiling: int = NEGATIVE_RATING_CEILING
) -> DataFrame:
    """Drop middling ratings and add the binary label."""
    rating = F.col("rating")
    return df.where(columns.is_binary_rating(rating, floor, ceiling)).withColumn(
        "sentiment", columns.sentiment(rating, floor)
    )


def text_and_label(df: DataFrame) -> DataFrame:
    return df.select("unique_id", "review_text", "sentiment")


def route_segment(df: DataFrame, test_id: str, record_id: str = "unique_id") -> DataFrame:
    """Labelled rows of the segment with their A/B variant."""
    return sentiment_rows(df).withColumn("variant", ab_variant(F.col(record_id), test_id))


def capped_sample(df: DataFrame, record_id: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows in hash order: a top-k, the same rows under any partitioning."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(record_id).cast("string")), 256)
    return df.orderBy(order, record_id).limit(cap)


def head_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
