"""Population-stability drift of numeric features.

Bin edges are a handful of numbers per feature: they are found first and then enter the
histogram pass as literals, which keeps that pass a single map-side aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugemill.operators.quantiles import FEW_ROWS, values_at_ranks
from gaugemill.settings import (
    NO_DRIFT_EXIT_CODE,
    PSI_BINS,
    PSI_EPSILON,
    PSI_MODERATE,
    PSI_SIGNIFICANT,
)


def _numbers(df: DataFrame, features: Sequence[str], is_reference: str) -> DataFrame:
    """The features as doubles, NaN as null."""
    cells = [F.col(f).cast("double") for f in features]
    return df.select(
        F.col(is_reference).alias("_ref"), *[F.when(~F.isnan(c), c).alias(f) for f, c in zip(features, cells)]
    )


def _interpolated(low: float, high: float, fraction: float) -> float:
    if low == high:
        return low
    return low + (high - low) * fraction if fraction < 0.5 else high - (high - low) * (1 - fraction)


def quantile_edges(
    df: DataFrame, features: Sequence[str], is_reference: str, bins: int = PSI_BINS, few: int = FEW_ROWS
) -> dict[str, list[float]]:
    """Distinct reference quantiles of each feature, exact and linearly interpolated.

    The outermost two stand for minus and plus infinity; a constant reference has one edge.
    """
    rows = _numbers(df, features, is_reference).where("_ref")
    sizes = rows.agg(*[F.count(f).alias(f) for f in features]).first().asDict()
    step = 1.0 / bins
    places = {
        f: [(sizes[f] - 1) * (1.0 if i == bins else i * step) for i in range(bins + 1)] for f in features if sizes[f]
    }
    ranks = {f: [(math.floor(p), math.ceil(p)) for p in at] for f, at in places.items()}
    found = values_at_ranks(rows, ranks, sizes, few)
    edges: dict[str, list[float]] = {f: [] for f in features}
    for f, pairs in found.items():
        edges[f] = sorted({_interpolated(lo, hi, p - math.floor(p)) for (lo, hi), p in zip(pairs, places[f])})
    return edges


def histogram_shares(
    df: DataFrame, edges: Mapping[str, Sequence[float]], is_reference: str, epsilon: float = PSI_EPSILON
) -> DataFrame:
    """Expected and actual share of every bin, empty ones included, floored at ``epsilon``."""
    binned = {f: cuts for f, cuts in edges.items() if len(cuts) > 1}
    rows = _numbers(df, list(edges), is_reference).where(F.col("_ref").isNotNull())
    if not binned:
        return rows.sparkSession.createDataFrame([], "feature string, bin int, expected double, actual double")
    cells = []
    for f, cuts in binned.items():
        place = F.when(F.col(f).isNotNull(), 0)
        for cut in cuts[1:-1]:
            place = place + (F.col(f) >= cut).cast("int")
        cells.append(F.struct(F.lit(f).alias("feature"), place.alias("bin")))
    counts = (
        rows.select("_ref", F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count_if("_ref").alias("n_ref"), F.count_if(~F.col("_ref")).alias("n_cur"))
    )
    every_bin = rows.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(i).alias("bin")) for f, cuts in binned.items() for i in range(len(cuts) - 1)
    ])))
    whole = Window.partitionBy("feature")  # one row per bin by now

    def share(part: str) -> Column:
        n = F.coalesce(F.col(part), F.lit(0))
        return F.greatest(n / F.greatest(F.sum(n).over(whole), F.lit(1)), F.lit(epsilon))

    return every_bin.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", share("n_ref").alias("expected"), share("n_cur").alias("actual")
    )


def psi(
    df: DataFrame, features: Sequence[str], is_reference: str, bins: int = PSI_BINS, epsilon: float = PSI_EPSILON
) -> DataFrame:
    """Population stability index and bin count per feature; 0 for a constant reference."""
    edges = quantile_edges(df, features, is_reference, bins)
    term = (F.col("actual") - F.col("expected")) * F.ln(F.col("actual") / F.col("expected"))
    scores = histogram_shares(df, edges, is_reference, epsilon).groupBy("feature").agg(
        F.sum(term).alias("psi"), F.count("*").alias("bins")
    )
    unbinned = [f for f in features if len(edges[f]) < 2]
    if not unbinned:
        return scores
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in unbinned])).alias("feature"))
    return scores.unionByName(names.select("feature", F.lit(0.0).alias("psi"), F.lit(0).cast("bigint").alias("bins")))


def drift_band(value: Column) -> Column:
    return (
        F.when(value > PSI_SIGNIFICANT, "significant").when(value > PSI_MODERATE, "moderate").otherwise("none")
    )


def drift_measure(
    df: DataFrame, features: Sequence[str], is_reference: str, bins: int = PSI_BINS
) -> DataFrame:
    """PSI of each feature with the row counts of both sides."""
    sizes = df.agg(
        F.struct(
            F.count_if(F.col(is_reference)).alias("reference_rows"),
            F.count_if(~F.col(is_reference)).alias("current_rows"),
        )
    )
    return (
        psi(df, features, is_reference, bins)
        .withColumn("_sizes", sizes.scalar())
        .select("feature", "psi", "bins", "_sizes.reference_rows", "_sizes.current_rows")
    )


def psi_gate(measured: DataFrame, limit: float = PSI_SIGNIFICANT) -> DataFrame:
    return measured.withColumn("threshold", F.lit(limit)).withColumn("passed", F.col("psi") <= limit)


def drift_verdict(measured: DataFrame, limit: float = PSI_SIGNIFICANT) -> DataFrame:
    """Band, verdict and the exit codes a gate and a branch step would return."""
    gated = psi_gate(measured, limit)
    return gated.select(
        "*",
        drift_band(F.col("psi")).alias("band"),
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("verdict"),
        F.when(F.col("passed"), 0).otherwise(1).alias("gate_exit_code"),
        F.when(F.col("passed"), NO_DRIFT_EXIT_CODE).otherwise(0).alias("branch_exit_code"),
    )
