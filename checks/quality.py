"""Data-quality and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, view
from gaugemill.operators import drift, quality

_EARLY = "o_orderdate < timestamp '1999-01-01 00:00:00'"
_FEATURES = ("l_quantity", "l_extendedprice", "l_discount")

_MISSING = """
SELECT is_ref, avg(case when category is null then 1.0 else 0.0 end) AS r FROM categories GROUP BY is_ref"""
_KS = """
WITH d AS (SELECT rating, sum(case when is_ref then 1 else 0 end) AS a,
                  sum(case when is_ref then 0 else 1 end) AS b FROM ratings GROUP BY rating),
c AS (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM d
      WINDOW w AS (ORDER BY rating)),
k AS (SELECT max(abs(a / na - b / nb)) AS ks, cast(max(na) AS bigint) AS reference_rows,
             cast(max(nb) AS bigint) AS current_rows FROM c)
"""
_TVD = """
WITH d AS (SELECT coalesce(category, '__MISSING__') AS c, sum(case when is_ref then 1 else 0 end) AS a,
                  sum(case when is_ref then 0 else 1 end) AS b FROM categories GROUP BY 1),
t AS (SELECT 0.5 * sum(abs(a / na - b / nb)) AS tvd, cast(max(na) AS bigint) AS reference_rows,
             cast(max(nb) AS bigint) AS current_rows
      FROM (SELECT a, b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM d))
"""


def _psi_sql(values: str) -> str:
    """CTEs v, cuts, shares and scores for rows (feature, x, ref)."""
    return f"""
WITH v AS ({values}),
r AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k,
             count(*) OVER (PARTITION BY feature) AS n FROM v WHERE ref),
p AS (SELECT feature, i, (n - 1) * (case when i = 10 then 1.0::double else i * (1.0::double / 10.0::double) end) AS pos
      FROM (SELECT DISTINCT feature, n FROM r), range(11) AS g(i)),
q AS (SELECT p.feature, p.i, p.pos - floor(p.pos) AS f, a.x AS lo, b.x AS hi FROM p
      JOIN r a ON a.feature = p.feature AND a.k = floor(p.pos)
      JOIN r b ON b.feature = p.feature AND b.k = ceil(p.pos)),
e AS (SELECT DISTINCT feature, case when lo = hi then lo when f < 0.5 then lo + (hi - lo) * f
                                    else hi - (hi - lo) * (1 - f) end AS edge FROM q),
m AS (SELECT feature, count(*) - 1 AS n_bins, min(edge) AS first, max(edge) AS last FROM e GROUP BY feature),
cuts AS (SELECT m.feature, m.n_bins, list(e.edge ORDER BY e.edge)
           FILTER (WHERE e.edge > m.first AND e.edge < m.last) AS cuts
         FROM m JOIN e ON e.feature = m.feature GROUP BY m.feature, m.n_bins),
b AS (SELECT v.feature, v.ref, coalesce(len(list_filter(c.cuts, lambda t: t <= v.x)), 0) AS bin
      FROM v JOIN cuts c ON v.feature = c.feature),
h AS (SELECT feature, bin, sum(case when ref then 1 else 0 end) AS a, sum(case when ref then 0 else 1 end) AS c
      FROM b GROUP BY feature, bin),
shares AS (SELECT feature, bin, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS expected,
                  greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS actual FROM h),
scores AS (SELECT feature, sum((actual - expected) * ln(actual / expected)) AS psi, count(*) AS bins
           FROM shares GROUP BY feature)
"""


_ORDER_VALUES = f"SELECT 'o_totalprice' AS feature, o_totalprice AS x, {_EARLY} AS ref FROM orders"
_SHIP_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, is_ref AS ref FROM shipments" for f in _FEATURES)
_SIZES = ("(SELECT count(*) FROM v WHERE ref AND feature = scores.feature) AS reference_rows, "
          "(SELECT count(*) FROM v WHERE NOT ref AND feature = scores.feature) AS current_rows")


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_totalprice", (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("is_ref")
    )


def order_drift(spark, sf):
    return drift.drift_measure(_orders(spark, sf), ["o_totalprice"], "is_ref")


def _rounded(df, *names, places=9):
    return df.withColumns({n: F.round(n, places) for n in names})


def missing_rate(spark, sf):
    return _rounded(quality.missing_rates(view(spark, sf, "categories"), ["category"], ["is_ref"]), "category_missing_rate")


def missing_gate(spark, sf):
    gate = quality.missing_gate(view(spark, sf, "categories"), "category", ["is_ref"])
    return _rounded(gate, "category_missing_rate")


def ks_stat(spark, sf):
    return _rounded(quality.ks_statistic(view(spark, sf, "ratings"), "rating", "is_ref"), "ks")


def ks_stat_wide(spark, sf):
    """KS over a column with about as many distinct values as rows."""
    return _rounded(quality.ks_statistic(_orders(spark, sf), "o_totalprice", "is_ref"), "ks")


def ks_gate(spark, sf):
    return _rounded(quality.ks_gate(view(spark, sf, "ratings"), "rating", "is_ref"), "ks")


def tvd(spark, sf):
    return _rounded(quality.total_variation(view(spark, sf, "categories"), "category", "is_ref"), "tvd")


def tvd_gate(spark, sf):
    return _rounded(quality.tvd_gate(view(spark, sf, "categories"), "category", "is_ref"), "tvd")


def quantile_edges(spark, sf):
    rows = view(spark, sf, "shipments")
    edges = drift.quantile_edges(rows, _FEATURES, "is_ref")
    cuts = [
        F.struct(F.lit(f).alias("feature"), F.lit(len(e) - 1).alias("n_bins"), F.lit(i).alias("position"), F.lit(x).alias("cut"))
        for f, e in edges.items() for i, x in enumerate(e[1:-1])
    ]
    return _rounded(spark.range(1).select(F.inline(F.array(*cuts))), "cut", places=6)


def histogram_shares(spark, sf):
    rows = view(spark, sf, "shipments")
    shares = drift.histogram_shares(rows, drift.quantile_edges(rows, _FEATURES, "is_ref"), "is_ref")
    return _rounded(shares, "expected", "actual")


def psi(spark, sf):
    return _rounded(order_drift(spark, sf).select("feature", "psi", "bins"), "psi")


def psi_gate(spark, sf):
    return _rounded(drift.psi_gate(order_drift(spark, sf)), "psi").select("feature", "psi", "threshold", "passed")


def drift_measure(spark, sf):
    return _rounded(drift.drift_measure(view(spark, sf, "shipments"), _FEATURES, "is_ref"), "psi")


def drift_band(spark, sf):
    rows = view(spark, sf, "measurements")
    return rows.select("seq", drift.drift_band(F.col("psi")).alias("band"))


def drift_verdict(spark, sf):
    return _rounded(drift.drift_verdict(drift.drift_measure(view(spark, sf, "shipments"), _FEATURES, "is_ref")), "psi")


def drift_gate_branch(spark, sf):
    verdict = drift.drift_verdict(drift.drift_measure(view(spark, sf, "shipments"), _FEATURES, "is_ref"))
    return verdict.select("feature", "gate_exit_code", "branch_exit_code")


def quality_summary(spark, sf):
    raw = view(spark, sf, "reviews_raw")
    reference, current = raw.where("split = 'reference'"), raw.where("split = 'current'")
    return quality.quality_summary(reference, current, raw)


QUERIES = {
    f.__name__: f
    for f in (missing_rate, missing_gate, ks_stat, ks_stat_wide, ks_gate, tvd, tvd_gate, quantile_edges,
              histogram_shares, psi, psi_gate, drift_measure, drift_band, drift_verdict, drift_gate_branch,
              quality_summary)
}

_VERDICT = """, judged AS (SELECT feature, round(psi, 9) AS psi, bins, 0.25::double AS threshold, psi <= 0.25 AS passed,
  case when psi > 0.25 then 'significant' when psi > 0.10 then 'moderate' else 'none' end AS band,
  case when psi <= 0.25 then 'PASS' else 'FAIL' end AS verdict,
  cast(case when psi <= 0.25 then 0 else 1 end AS int) AS gate_exit_code,
  cast(case when psi <= 0.25 then 64 else 0 end AS int) AS branch_exit_code, """ + _SIZES + " FROM scores) "

ORACLES = {
    "missing_rate": oracle(f"SELECT is_ref, round(r, 9) AS category_missing_rate FROM ({_MISSING})", "categories"),
    "missing_gate": oracle(
        "SELECT is_ref, round(r, 9) AS category_missing_rate, 0.01::double AS threshold, r <= 0.01 AS passed "
        f"FROM ({_MISSING})", "categories"),
    "ks_stat": oracle(_KS + "SELECT round(ks, 9) AS ks, reference_rows, current_rows FROM k", "ratings"),
    "ks_stat_wide": _KS.replace("FROM ratings", f"FROM (SELECT o_totalprice AS rating, {_EARLY} AS is_ref FROM orders)")
    + "SELECT round(ks, 9) AS ks, reference_rows, current_rows FROM k",
    "ks_gate": oracle(
        _KS + "SELECT round(ks, 9) AS ks, reference_rows, current_rows, 0.02::double AS threshold, ks <= 0.02 AS passed FROM k",
        "ratings"),
    "tvd": oracle(_TVD + "SELECT round(tvd, 9) AS tvd, reference_rows, current_rows FROM t", "categories"),
    "tvd_gate": oracle(
        _TVD + "SELECT round(tvd, 9) AS tvd, reference_rows, current_rows, 0.05::double AS threshold, tvd <= 0.05 AS passed FROM t",
        "categories"),
    "quantile_edges": oracle(
        _psi_sql(_SHIP_VALUES) + "SELECT feature, cast(n_bins AS int) AS n_bins, cast(position AS int) AS position, round(cut, 6) AS cut "
        "FROM (SELECT feature, n_bins, unnest(cuts) AS cut, generate_subscripts(cuts, 1) - 1 AS position FROM cuts)",
        "shipments"),
    "histogram_shares": oracle(
        _psi_sql(_SHIP_VALUES) + "SELECT feature, cast(bin AS int) AS bin, round(expected, 9) AS expected, round(actual, 9) AS actual FROM shares",
        "shipments"),
    "psi": _psi_sql(_ORDER_VALUES) + "SELECT feature, round(psi, 9) AS psi, bins FROM scores",
    "psi_gate": _psi_sql(_ORDER_VALUES)
    + "SELECT feature, round(psi, 9) AS psi, 0.25::double AS threshold, psi <= 0.25 AS passed FROM scores",
    "drift_measure": oracle(
        _psi_sql(_SHIP_VALUES) + f"SELECT feature, round(psi, 9) AS psi, bins, {_SIZES} FROM scores", "shipments"),
    "drift_band": oracle(
        "SELECT seq, case when psi > 0.25 then 'significant' when psi > 0.10 then 'moderate' else 'none' end AS band "
        "FROM measurements", "measurements"),
    "drift_verdict": oracle(_psi_sql(_SHIP_VALUES) + _VERDICT + "SELECT * FROM judged", "shipments"),
    "drift_gate_branch": oracle(
        _psi_sql(_SHIP_VALUES) + _VERDICT + "SELECT feature, gate_exit_code, branch_exit_code FROM judged", "shipments"),
    "quality_summary": oracle("""
WITH s AS (SELECT *, split = 'reference' AS is_ref FROM reviews_raw),
kd AS (SELECT rating, count(*) FILTER (WHERE is_ref) AS a, count(*) FILTER (WHERE NOT is_ref) AS b FROM s GROUP BY rating),
kc AS (SELECT sum(a) OVER (ORDER BY rating) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY rating) / sum(b) OVER () AS fb FROM kd),
td AS (SELECT coalesce(condition, '__MISSING__') AS c, count(*) FILTER (WHERE is_ref) AS a,
              count(*) FILTER (WHERE NOT is_ref) AS b FROM s GROUP BY 1),
tc AS (SELECT abs(a / sum(a) OVER () - b / sum(b) OVER ()) AS d FROM td)
SELECT 'UCI Drug Review Dataset' AS dataset,
       count(*) FILTER (WHERE is_ref) AS reference_rows, count(*) FILTER (WHERE NOT is_ref) AS current_rows,
       count(*) AS training_rows, count(*) FILTER (WHERE NOT is_ref) AS incoming_train_rows,
       round(avg(case when condition is null then 1.0 else 0.0 end) FILTER (WHERE is_ref), 6) AS condition_missing_rate_reference,
       round(avg(case when condition is null then 1.0 else 0.0 end) FILTER (WHERE NOT is_ref), 6) AS condition_missing_rate_current,
       (SELECT round(max(abs(fa - fb)), 6) FROM kc) AS rating_ks_reference_vs_current,
       (SELECT round(0.5 * sum(d), 6) FROM tc) AS condition_tvd_reference_vs_current
FROM s""", "reviews_raw"),
}
