import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemill.operators import drift, quality, quantiles


def _frame(spark, reference, current):
    rows = [(float(x), True) for x in reference] + [(float(x), False) for x in current]
    return spark.createDataFrame(rows, "x double, ref boolean").repartition(4)


def _numpy_psi(reference, current, bins=10, epsilon=1e-6):
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    def shares(v):
        counts, _ = np.histogram(v, bins=edges)
        return np.clip(counts / max(counts.sum(), 1), epsilon, None)
    e, a = shares(reference), shares(current)
    return float(np.sum((a - e) * np.log(a / e)))


@pytest.mark.parametrize("shift", [0, 5, 60])
def test_psi_equals_numpy(spark, shift):
    rng = np.random.default_rng(0)
    reference, current = rng.normal(100, 15, 5000), rng.normal(100 + shift, 15, 5000)
    got = drift.psi(_frame(spark, reference, current), ["x"], "ref").first()["psi"]
    assert got == pytest.approx(_numpy_psi(reference, current), rel=1e-9)


def test_psi_of_small_integers_with_ties(spark):
    rng = np.random.default_rng(1)
    reference, current = rng.integers(0, 12, 4000), rng.integers(0, 9, 3000)
    got = drift.psi(_frame(spark, reference, current), ["x"], "ref").first()["psi"]
    assert got == pytest.approx(_numpy_psi(reference.astype(float), current.astype(float)), rel=1e-9)


def test_identical_and_constant_references(spark):
    values = np.linspace(0, 100, 1000)
    assert drift.psi(_frame(spark, values, values), ["x"], "ref").first()["psi"] < 1e-9
    row = drift.psi(_frame(spark, [3.0] * 50, [1.0, 2.0]), ["x"], "ref").first()
    assert (row["psi"], row["bins"]) == (0.0, 0)


def test_nulls_and_nan_stay_out_of_bins(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (None, True), (float("nan"), False), (1.5, False), (None, False)],
                               "x double, ref boolean")
    shares = drift.histogram_shares(df, {"x": [1.0, 2.0]}, "ref").collect()
    assert [(r["expected"], r["actual"]) for r in shares] == [(1.0, 1.0)]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties"])
def test_bracket_narrowing_is_exact(spark, kind):
    rng = np.random.default_rng(2)
    values = {
        "normal": rng.normal(0, 1, 40000),
        "heavy": rng.pareto(0.5, 40000),
        "ties": np.where(rng.random(40000) < 0.7, 5.0, rng.normal(5, 1, 40000)),
    }[kind]
    df = _frame(spark, values, [0.0])
    edges = drift.quantile_edges(df, ["x"], "ref", 10, few=500)["x"]
    expected = np.unique(np.quantile(values, np.linspace(0, 1, 11)))
    assert edges == pytest.approx(expected.tolist(), rel=1e-12)


def test_ranks_of_two_columns(spark):
    df = spark.range(1, 5001).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))
    found = quantiles.values_at_ranks(df, {"a": [(0, 1), (2500, 2500)], "b": [(4999, 4999)]}, {"a": 5000, "b": 5000}, few=100)
    assert found == {"a": [(1.0, 2.0), (2501.0, 2501.0)], "b": [(-1.0, -1.0)]}


@pytest.mark.parametrize("kind", ["spread", "ties", "two values", "constant"])
def test_ranks_at_the_ends_and_inside_ties(spark, kind):
    rng = np.random.default_rng(8)
    values = {
        "spread": rng.normal(0, 1, 30_000), "ties": np.where(rng.random(30_000) < 0.6, 0.0, rng.normal(0, 1, 30_000)),
        "two values": np.where(rng.random(30_000) < 0.5, 1.0, 2.0), "constant": np.full(30_000, 3.0),
    }[kind]
    ranks = [0, 1, 2999, 15_000, 17_999, 29_998, 29_999]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = quantiles.values_at_ranks(df, {"x": [(r, r) for r in ranks]}, {"x": 30_000}, few=50)["x"]
    assert found == [(v, v) for v in np.sort(values)[ranks].tolist()]


def _numpy_ks(a, b):
    grid = np.concatenate([a, b])
    grid.sort()
    cdf = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    return float(np.max(np.abs(cdf(a) - cdf(b))))


@pytest.mark.parametrize("hot", [False, True])
def test_ks_equals_numpy(spark, hot):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 3000), rng.normal(0.1, 1, 2000)
    if hot:  # one value holds a third of all rows
        a[:1500], b[:200] = 0.25, 0.25
    row = quality.ks_statistic(_frame(spark, a, b), "x", "ref").first()
    assert row["ks"] == pytest.approx(_numpy_ks(a, b), abs=1e-12)
    assert (row["reference_rows"], row["current_rows"]) == (3000, 2000)


def test_tvd_and_gates(spark):
    rows = [("a", True)] * 6 + [("b", True)] * 3 + [(None, True)] + [("a", False)] * 2 + [("c", False)] * 2
    df = spark.createDataFrame(rows, "c string, ref boolean")
    assert quality.total_variation(df, "c", "ref").first()["tvd"] == pytest.approx(0.5 * (0.1 + 0.3 + 0.1 + 0.5))
    gate = quality.tvd_gate(df, "c", "ref")
    assert gate.first()["passed"] is False
    with pytest.raises(quality.GateFailed):
        quality.enforce(gate, "tvd", "TVD")
    assert quality.missing_gate(df, "c", limit=1 / 14).first()["passed"] is True


def test_bands_are_strict(spark):
    df = spark.createDataFrame([(0.25,), (0.2500001,), (0.10,), (0.11,)], "psi double")
    assert [r[0] for r in df.select(drift.drift_band(F.col("psi"))).collect()] == ["moderate", "significant", "none", "moderate"]
    measured = df.select(F.lit("f").alias("feature"), "psi", F.lit(10).alias("bins"))
    codes = drift.drift_verdict(measured).select("gate_exit_code", "branch_exit_code").collect()
    assert [tuple(c) for c in codes] == [(0, 64), (1, 0), (0, 64), (0, 64)]
