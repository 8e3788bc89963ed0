"""Classifier-score queries over label and prediction columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.splits import _variant
from checks.views import oracle, table, view
from gaugemill.functions.hashing import ab_variant
from gaugemill.operators import evaluation, lifecycle


def _f1_sql(source: str, groups: str = "") -> str:
    """CTE s(groups.., n, macro_f1, majority_class, majority_macro_f1) for rows (groups.., y, p)."""
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    join = " AND ".join(f"c.{x.strip()} = r.{x.strip()}" for x in groups.split(",")) if groups else "true"
    on = f"USING ({groups})" if groups else "ON true"
    return f"""
r AS ({source}),
c AS (SELECT {g}y AS k FROM r UNION SELECT {g}p FROM r),
f AS (SELECT {', '.join('c.' + x.strip() for x in groups.split(',')) + ', ' if groups else ''}c.k,
        sum(case when r.y = c.k and r.p = c.k then 1 else 0 end) AS tp,
        sum(case when r.y = c.k and r.p <> c.k then 1 else 0 end) AS fn,
        sum(case when r.y <> c.k and r.p = c.k then 1 else 0 end) AS fp
      FROM c JOIN r ON {join} GROUP BY ALL),
a AS (SELECT {g}avg(2.0 * tp / (2 * tp + fn + fp)) AS macro_f1 FROM f {by}),
m AS (SELECT {g}count(*) AS n, mode(y) AS any_mode, count(DISTINCT y) AS classes FROM r {by}),
t AS (SELECT {g}max(tp + fn) AS top FROM f {by}),
j AS (SELECT {g}min(k) AS majority_class FROM f JOIN t {on} WHERE tp + fn = top {by}),
s AS (SELECT {g}n, macro_f1, majority_class, 2.0 * top / (n + top) / classes AS majority_macro_f1
      FROM a JOIN m {on} JOIN t {on} JOIN j {on})"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def macro_f1(spark, sf):
    """Three classes, scored per return flag over every line item."""
    return _rounded(evaluation.macro_f1(view(spark, sf, "shipments"), "y", "yhat", ["l_returnflag"]), "macro_f1")


def macro_f1_binary(spark, sf):
    return _rounded(evaluation.macro_f1(view(spark, sf, "preds"), "y", "yhat_a"), "macro_f1")


def majority_baseline(spark, sf):
    return _rounded(evaluation.majority_baseline(view(spark, sf, "shipments"), "y", ["l_returnflag"]), "majority_macro_f1")


def baseline_margin(spark, sf):
    return _rounded(evaluation.baseline_margin(view(spark, sf, "preds"), "y", "yhat_a"), "macro_f1", "majority_macro_f1", "margin")


def score_candidates(spark, sf):
    scored = evaluation.candidate_scores(view(spark, sf, "preds"), "y", {"first": "yhat_a", "second": "yhat_b"})
    return _rounded(scored, "macro_f1")


def pick_winner(spark, sf):
    scored = evaluation.macro_f1(view(spark, sf, "shipments"), "y", "yhat", ["l_returnflag"])
    return _rounded(evaluation.pick_winner(scored, "l_returnflag"), "macro_f1")


def selection_record(spark, sf):
    """Winner of each customer segment's candidate flags."""
    scored = evaluation.candidate_scores(view(spark, sf, "preds"), "y", {"first": "yhat_a", "second": "yhat_b"})
    best = evaluation.pick_winner(scored)
    ranking = scored.agg(F.array_join(F.array_sort(F.collect_list(  # one entry per candidate
        F.concat("candidate", F.lit("="), F.format_number("macro_f1", 4)))), ",").alias("ranking"))
    return best.select(F.col("candidate").alias("variant"), "n", F.round("macro_f1", 9).alias("macro_f1"),
                       ranking.scalar().alias("ranking"))


def _routed(spark, sf):
    return view(spark, sf, "preds").withColumn("variant", ab_variant(F.col("unique_id"), "ab-1"))


def ab_score(spark, sf):
    return _rounded(evaluation.ab_scores(_routed(spark, sf), "y", "yhat_a", "yhat_b"), "macro_f1")


def ab_measure(spark, sf):
    measured = evaluation.ab_measure(evaluation.ab_scores(_routed(spark, sf), "y", "yhat_a", "yhat_b"))
    return _rounded(measured, "macro_f1_A", "macro_f1_B")


def should_promote(spark, sf):
    """Candidate against champion on the whole segment, margin 0.01."""
    scored = evaluation.candidate_scores(view(spark, sf, "preds"), "y", {"champion": "yhat_b", "candidate": "yhat_a"})
    pair = scored.agg(
        F.max(F.when(F.col("candidate") == "champion", F.col("macro_f1"))).alias("champion_macro_f1"),
        F.max(F.when(F.col("candidate") == "candidate", F.col("macro_f1"))).alias("candidate_macro_f1"),
    )
    return _rounded(lifecycle.promotion_decision(pair), "champion_macro_f1", "candidate_macro_f1", "margin")


def agreement(spark, sf):
    """Share of equal predictions, per status, of two prediction columns."""
    rows = table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_quantity") > 10).alias("before"), (F.col("l_quantity") > 11).alias("after")
    )
    return _rounded(evaluation.agreement(rows, "before", "after", ["l_linestatus"]), "agreement")


def negation_drop(spark, sf):
    """Mean drop of the predicted class's probability over every line item."""
    p = F.col("l_discount") * 5 + 0.4
    q = F.col("l_tax") * 5 + 0.3
    rows = table(spark, sf, "lineitem").select(
        F.array(1 - p, p).alias("before"), F.array(1 - q, q).alias("after"), (F.col("l_discount") > 0.02).cast("int").alias("c")
    )
    return _rounded(evaluation.negation_shift(rows, "before", "after", "c"), "mean_drop")


QUERIES = {
    f.__name__: f
    for f in (macro_f1, macro_f1_binary, majority_baseline, baseline_margin, score_candidates, pick_winner,
              selection_record, ab_score, ab_measure, should_promote, agreement, negation_drop)
}

_SHIP = "SELECT l_returnflag, y, yhat AS p FROM shipments"
_TWO = ("SELECT 'first' AS candidate, y, yhat_a AS p FROM preds UNION ALL "
        "SELECT 'second', y, yhat_b FROM preds")
_AB = (f"SELECT variant, y, case when variant = 'A' then yhat_a else yhat_b end AS p FROM "
       f"(SELECT *, {_variant(chr(39) + 'ab-1:' + chr(39) + ' || unique_id')} AS variant FROM preds)")
ORACLES = {
    "macro_f1": oracle("WITH " + _f1_sql(_SHIP, "l_returnflag") + " SELECT l_returnflag, n, round(macro_f1, 9) AS macro_f1 FROM s", "shipments"),
    "macro_f1_binary": oracle("WITH " + _f1_sql("SELECT y, yhat_a AS p FROM preds") + " SELECT n, round(macro_f1, 9) AS macro_f1 FROM s", "preds"),
    "majority_baseline": oracle(
        "WITH " + _f1_sql(_SHIP, "l_returnflag") + " SELECT l_returnflag, n, majority_class, round(majority_macro_f1, 9) AS majority_macro_f1 FROM s",
        "shipments"),
    "baseline_margin": oracle(
        "WITH " + _f1_sql("SELECT y, yhat_a AS p FROM preds")
        + " SELECT n, round(macro_f1, 9) AS macro_f1, majority_class, round(majority_macro_f1, 9) AS majority_macro_f1, "
          "round(macro_f1 - majority_macro_f1, 9) AS margin, 0.2::double AS threshold, macro_f1 - majority_macro_f1 >= 0.2 AS passed FROM s",
        "preds"),
    "score_candidates": oracle("WITH " + _f1_sql(_TWO, "candidate") + " SELECT candidate, n, round(macro_f1, 9) AS macro_f1 FROM s", "preds"),
    "pick_winner": oracle(
        "WITH " + _f1_sql(_SHIP, "l_returnflag") + " SELECT l_returnflag, n, round(macro_f1, 9) AS macro_f1 FROM s "
        "ORDER BY s.macro_f1 DESC, l_returnflag LIMIT 1", "shipments"),
    "selection_record": oracle(
        "WITH " + _f1_sql(_TWO, "candidate") + " SELECT candidate AS variant, n, round(macro_f1, 9) AS macro_f1, "
        "(SELECT string_agg(candidate || '=' || printf('%.4f', macro_f1), ',' ORDER BY candidate) FROM s) AS ranking "
        "FROM s ORDER BY s.macro_f1 DESC, candidate LIMIT 1", "preds"),
    "ab_score": oracle("WITH " + _f1_sql(_AB, "variant") + " SELECT variant, n, round(macro_f1, 9) AS macro_f1 FROM s", "preds"),
    "ab_measure": oracle(
        "WITH " + _f1_sql(_AB, "variant") + " SELECT a.n AS n_A, b.n AS n_B, round(a.macro_f1, 9) AS macro_f1_A, "
        "round(b.macro_f1, 9) AS macro_f1_B, case when a.macro_f1 >= b.macro_f1 then 'A' else 'B' end AS winner "
        "FROM s a JOIN s b ON a.variant = 'A' AND b.variant = 'B'", "preds"),
    "should_promote": oracle(
        "WITH " + _f1_sql(_TWO, "candidate") + " SELECT round(b.macro_f1, 9) AS champion_macro_f1, "
        "round(a.macro_f1, 9) AS candidate_macro_f1, round(a.macro_f1 - b.macro_f1, 9) AS margin, "
        "case when a.macro_f1 - b.macro_f1 >= 0.01 then 'promote' else 'keep' end AS decision "
        "FROM s a JOIN s b ON a.candidate = 'first' AND b.candidate = 'second'", "preds"),
    "agreement": "SELECT l_linestatus, count(*) AS n, round(avg(case when (l_quantity > 10) = (l_quantity > 11) then 1.0 else 0.0 end), 9) AS agreement, "
                 "avg(case when (l_quantity > 10) = (l_quantity > 11) then 1.0 else 0.0 end) >= 0.95 AS passed FROM lineitem GROUP BY 1",
    "negation_drop": "SELECT count(*) AS n, round(avg(d), 9) AS mean_drop, avg(d) >= 0.15 AS passed FROM (SELECT case when l_discount > 0.02 "
                     "then (l_discount * 5 + 0.4) - (l_tax * 5 + 0.3) else (1 - (l_discount * 5 + 0.4)) - (1 - (l_tax * 5 + 0.3)) end AS d FROM lineitem)",
}
