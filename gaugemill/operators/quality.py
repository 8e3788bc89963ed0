"""Data-quality statistics and their gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.operators.ordered import running_totals
from gaugemill.settings import DATASET_NAME, MAX_KS, MAX_MISSING_RATE, MAX_TVD, MISSING_CATEGORY


class GateFailed(AssertionError):
    """A measured value is on the wrong side of its limit."""


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def missing_rates(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Null share of every named column, all in one pass."""
    return df.groupBy(*groups).agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing_rate") for c in columns]
    )


def missing_gate(
    df: DataFrame, column: str, groups: Sequence[str] = (), limit: float = MAX_MISSING_RATE
) -> DataFrame:
    rate = f"{column}_missing_rate"
    return at_most(missing_rates(df, [column], groups), rate, limit)


def at_most(measured: DataFrame, metric: str, limit: float) -> DataFrame:
    """Add ``threshold`` and ``passed``; only a value above the limit fails."""
    return measured.withColumn("threshold", F.lit(limit)).withColumn("passed", F.col(metric) <= limit)


def enforce(gated: DataFrame, metric: str, what: str) -> DataFrame:
    """Raise GateFailed when any row of a gate table failed."""
    failed = gated.where(~F.col("passed")).select(metric, "threshold").first()
    if failed is not None:
        raise GateFailed(f"{what} {failed[0]:.6f} exceeds the threshold {failed[1]:.6f}.")
    return gated


def ks_statistic(df: DataFrame, value: str, is_reference: str) -> DataFrame:
    """Largest gap between the two empirical distribution functions, with row counts.

    Rows collapse to distinct values before anything is ordered. Nulls and NaN are left out.
    """
    number = F.col(value).cast("double")
    counts = (
        df.select(number.alias("value"), F.col(is_reference).alias("ref"))
        .where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("ref").isNotNull())
        .groupBy("value")
        .agg(F.count_if("ref").alias("n_ref"), F.count_if(~F.col("ref")).alias("n_cur"))
        .where(F.col("n_ref") + F.col("n_cur") > 0)
    )
    both = running_totals(counts, "value", {"ref": "n_ref", "cur": "n_cur"})
    gap = F.abs(_share(F.col("ref"), F.col("all_ref")) - _share(F.col("cur"), F.col("all_cur")))
    return both.agg(
        F.max(gap).alias("ks"), F.max("all_ref").alias("reference_rows"), F.max("all_cur").alias("current_rows")
    )


def ks_gate(df: DataFrame, value: str, is_reference: str, limit: float = MAX_KS) -> DataFrame:
    return at_most(ks_statistic(df, value, is_reference), "ks", limit)


def total_variation(
    df: DataFrame, category: str, is_reference: str, missing_label: str = MISSING_CATEGORY
) -> DataFrame:
    """Half the summed share differences over the union of categories.

    One conditional aggregate replaces a full outer join of two distributions.
    """
    counts = (
        df.select(
            F.coalesce(F.col(category).cast("string"), F.lit(missing_label)).alias("category"),
            F.col(is_reference).alias("ref"),
        )
        .groupBy("category")
        .agg(F.count_if("ref").alias("n_ref"), F.count_if(~F.col("ref")).alias("n_cur"))
        .where(F.col("n_ref") + F.col("n_cur") > 0)
    )
    sizes = counts.agg(F.struct(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur")))
    difference = F.abs(
        _share(F.col("n_ref"), F.col("_sizes.ref")) - _share(F.col("n_cur"), F.col("_sizes.cur"))
    )
    return counts.withColumn("_sizes", sizes.scalar()).agg(
        (F.sum(difference) * 0.5).alias("tvd"),
        F.max("_sizes.ref").alias("reference_rows"),
        F.max("_sizes.cur").alias("current_rows"),
    )


def tvd_gate(df: DataFrame, category: str, is_reference: str, limit: float = MAX_TVD) -> DataFrame:
    return at_most(total_variation(df, category, is_reference), "tvd", limit)


def quality_summary(
    reference: DataFrame,
    current: DataFrame,
    training: DataFrame,
    category: str = "condition",
    rating: str = "rating",
    dataset: str = DATASET_NAME,
) -> DataFrame:
    """One row: split sizes, missing rates, rating KS and category TVD, rounded to 6 places."""
    both = reference.select(F.col(category).alias("c"), F.col(rating).alias("r"), F.lit(True).alias("ref")).unionAll(
        current.select(F.col(category).alias("c"), F.col(rating).alias("r"), F.lit(False).alias("ref"))
    )
    rate = F.col("c").isNull().cast("double")
    sizes = both.agg(
        F.count_if("ref").alias("reference_rows"),
        F.count_if(~F.col("ref")).alias("current_rows"),
        F.round(F.avg(F.when(F.col("ref"), rate)), 6).alias(f"{category}_missing_rate_reference"),
        F.round(F.avg(F.when(~F.col("ref"), rate)), 6).alias(f"{category}_missing_rate_current"),
    )
    ks = ks_statistic(both, "r", "ref").select(F.round("ks", 6))
    tvd = total_variation(both, "c", "ref").select(F.round("tvd", 6))
    return sizes.select(
        F.lit(dataset).alias("dataset"),
        "*",
        training.agg(F.count("*")).scalar().alias("training_rows"),
        ks.scalar().alias(f"{rating}_ks_reference_vs_current"),
        tvd.scalar().alias(f"{category}_tvd_reference_vs_current"),
    ).withColumn("incoming_train_rows", F.col("training_rows") - F.col("reference_rows"))
