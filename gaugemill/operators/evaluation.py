"""Classifier scores from label and prediction columns, per group in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.settings import MIN_BASELINE_MARGIN, MIN_INVARIANCE_AGREEMENT, MIN_NEGATION_SHIFT


def class_counts(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """tp, fn and fp of each class. The data shrinks to a confusion table in its only wide pass."""
    confusion = df.groupBy(*groups, F.col(label).alias("y"), F.col(prediction).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit, n = F.col("y") == F.col("p"), F.col("n")
    none = F.lit(0).cast("bigint")
    as_label = F.struct(
        F.col("y").alias("class"),
        F.when(hit, n).otherwise(none).alias("tp"),
        F.when(hit, none).otherwise(n).alias("fn"),
        none.alias("fp"),
    )
    as_prediction = F.struct(
        F.col("p").alias("class"), none.alias("tp"), none.alias("fn"), F.when(hit, none).otherwise(n).alias("fp")
    )
    return (
        confusion.select(*groups, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*groups, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    )


def scores(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, macro-F1, always-majority macro-F1 and their margin for every group."""
    actual = F.col("tp") + F.col("fn")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    per_group = class_counts(df, label, prediction, groups).groupBy(*groups).agg(
        F.sum(actual).alias("n"),
        F.avg(f1).alias("macro_f1"),
        F.max(F.struct(actual.alias("size"), (-F.col("class")).alias("order"))).alias("_top"),
        F.count_if(actual > 0).alias("_classes"),
    )
    majority = 2 * F.col("_top.size") / (F.col("n") + F.col("_top.size")) / F.nullif("_classes", F.lit(0))
    return (
        per_group.select(
            *groups, "n", "macro_f1",
            (-F.col("_top.order")).alias("majority_class"),
            majority.alias("majority_macro_f1"),
        )
        .withColumn("margin", F.col("macro_f1") - F.col("majority_macro_f1"))
    )


def macro_f1(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    return scores(df, label, prediction, groups).select(*groups, "n", "macro_f1")


def majority_baseline(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    return scores(df, label, label, groups).select(*groups, "n", "majority_class", "majority_macro_f1")


def baseline_margin(
    df: DataFrame, label: str, prediction: str, groups: Sequence[str] = (), floor: float = MIN_BASELINE_MARGIN
) -> DataFrame:
    """Passes unless the margin is below the floor."""
    return scores(df, label, prediction, groups).withColumn("threshold", F.lit(floor)).withColumn(
        "passed", F.col("margin") >= floor
    )


def candidate_scores(df: DataFrame, label: str, predictions: dict[str, str]) -> DataFrame:
    """One score row per candidate: each holds its predictions in a column of ``df``."""
    cells = [F.struct(F.lit(n).alias("candidate"), F.col(c).alias("p")) for n, c in predictions.items()]
    return macro_f1(df.select(F.col(label).alias("y"), F.inline(F.array(*cells))), "y", "p", ["candidate"])


def pick_winner(scored: DataFrame, name: str = "candidate", metric: str = "macro_f1") -> DataFrame:
    """Row of the highest metric, the smallest name on ties."""
    return scored.orderBy(F.desc(metric), F.asc(name)).limit(1)


def ab_scores(routed: DataFrame, label: str, prediction_a: str, prediction_b: str) -> DataFrame:
    """Each variant's predictions scored on that variant's rows only."""
    chosen = F.when(F.col("variant") == "A", F.col(prediction_a)).otherwise(F.col(prediction_b))
    return macro_f1(routed.select("variant", F.col(label).alias("y"), chosen.alias("p")), "y", "p", ["variant"])


def ab_measure(scored: DataFrame) -> DataFrame:
    """One row: both variants' size and score, and the winner (A on ties)."""
    by_variant = {
        f"{metric}_{v}": F.max(F.when(F.col("variant") == v, F.col(metric)))
        for v in ("A", "B")
        for metric in ("n", "macro_f1")
    }
    return scored.agg(*[column.alias(name) for name, column in by_variant.items()]).withColumn(
        "winner",
        F.when(F.coalesce("macro_f1_A", F.lit(-1.0)) >= F.coalesce("macro_f1_B", F.lit(-1.0)), "A").otherwise("B"),
    )


def agreement(df: DataFrame, before: str, after: str, groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction survived a benign rewrite."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg((F.col(before) == F.col(after)).cast("double")).alias("agreement")
    ).withColumn("passed", F.col("agreement") >= MIN_INVARIANCE_AGREEMENT)


def negation_shift(df: DataFrame, before: str, after: str, predicted: str, floor: float = MIN_NEGATION_SHIFT) -> DataFrame:
    """Mean drop of the originally predicted class's probability; arrays hold one entry per class."""
    index = (F.col(predicted) + 1).cast("int")
    drop = F.element_at(F.col(before), index) - F.element_at(F.col(after), index)
    return df.agg(F.count("*").alias("n"), F.avg(drop).alias("mean_drop")).withColumn(
        "passed", F.col("mean_drop") >= floor
    )
