"""Promotion, drift-response and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, table, view
from gaugemill.operators import drift, lifecycle
from gaugemill.plans import experiments
from gaugemill.sources.tables import json_documents


def _log(spark, sf):
    return view(spark, sf, "promotions").select("line", "at", "seq", "flow_version_id", "run_id")


def champion_log(spark, sf):
    return lifecycle.champion_history(_log(spark, sf), ["line"], ["at", "seq"])


def champion_global_log(spark, sf):
    """The whole table as one log: a single group as large as the data."""
    return lifecycle.champion_history(_log(spark, sf), [], ["seq"]).select("seq", "run_id", "previous_run_id", "previous_version")


def champion_current(spark, sf):
    return lifecycle.current_champion(_log(spark, sf), ["line"], ["at", "seq"])


def champion_no_repeats(spark, sf):
    versions = _log(spark, sf).withColumn("run_id", F.col("flow_version_id"))
    return lifecycle.drop_repeats(versions, ["line"], ["at", "seq"]).select("line", "seq", "run_id")


def champion_challenge(spark, sf):
    """Each customer's selected order run against the live champion, where one exists."""
    live = lifecycle.current_champion(_log(spark, sf).where("flow_version_id <> 'v0'"), ["line"], ["at", "seq"])
    selected = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("line"), F.lit("v9").alias("flow_version_id"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("run_id"),
    )
    return lifecycle.challenge(selected, live, ["line"])


def promote_job(spark, sf):
    """Promotion decision for every order as a candidate against its predecessor as champion."""
    scored = lifecycle.with_previous(
        view(spark, sf, "promotions").withColumn("candidate_macro_f1", F.round(F.col("o_totalprice") % 1, 2)),
        ["line"], ["at", "seq"], {"champion_macro_f1": "candidate_macro_f1"},
    )
    decided = lifecycle.promotion_decision(scored)
    return decided.select("line", "seq", F.round("margin", 6).alias("margin"), "decision")


def decide_action(spark, sf):
    rows = view(spark, sf, "measurements")
    return rows.select("seq", lifecycle.decide_action(drift.drift_band(F.col("psi"))).alias("action"))


def cooldown(spark, sf):
    candidates = view(spark, sf, "measurements").where("psi > 0.10")
    judged = lifecycle.cooldown(candidates, "feature_key", "ts", "seq", 3 * 86400)
    return judged.select("feature_key", "seq", "accepted")


def adaptation_log(spark, sf):
    """Response to every measurement; retrains wait out a three-day cooldown."""
    rows = view(spark, sf, "measurements").withColumn("band", drift.drift_band(F.col("psi") * 2))
    measured = rows.withColumn("action", lifecycle.decide_action(F.col("band")))
    return lifecycle.adaptation_decisions(measured, "feature_key", "ts", "seq", 3 * 86400).select(
        "feature_key", "seq", "band", "action"
    )


def _results(spark, sf):
    """One result document per order."""
    e = view(spark, sf, "experiments")
    def trained(v, f1):
        return F.struct(F.col(v).alias("flow_version_id"), F.concat(F.lit("run-"), v).alias("run_id"),
                        F.col(f1).alias("eval_macro_f1"))
    scores = F.create_map(F.lit("B"), F.coalesce("f1_b", F.lit(0.0)), F.lit("A"), F.col("f1_a"))
    ab = F.struct(
        F.concat("experiment_id", F.lit("-ab-0v1")).alias("ab_test_id"), "version_a", "version_b",
        scores.alias("macro_f1"), F.create_map(F.lit("A"), F.lit(10), F.lit("B"), F.lit(12)).alias("n"),
        F.when(F.col("f1_a") >= F.coalesce("f1_b", F.lit(0.0)), "A").otherwise("B").alias("winner"),
    )
    return json_documents(
        e.select("experiment_id", F.array(trained("version_a", "f1_a"), trained("version_b", "f1_b")).alias("trained"),
                 F.col("verdict").alias("monitoring_verdict"), F.array(ab).alias("ab_results")), "value")


def experiment_summary(spark, sf):
    return experiments.summarize(experiments.parse_results(_results(spark, sf)))


def experiment_batch(spark, sf):
    """Pairs of trained configs compared through two joins on their positions."""
    e = view(spark, sf, "experiments")
    scores = e.select("experiment_id", F.posexplode(F.array("f1_a", F.coalesce("f1_b", F.lit(0.5)), F.lit(0.4))).alias("position", "macro_f1"))
    pair = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
    specs = e.select("experiment_id", F.array(pair(0, 1), pair(1, 2)).alias("ab_pairs"))
    return experiments.pair_comparisons(specs, scores)


QUERIES = {
    f.__name__: f
    for f in (champion_log, champion_global_log, champion_current, champion_no_repeats, champion_challenge, promote_job,
              decide_action, cooldown, adaptation_log, experiment_summary, experiment_batch)
}

_ACTION = "case when {0} > 0.25 then 'retrain' when {0} > 0.10 then 'alert' else 'none' end"


def _cooldown_sql(rows: str) -> str:
    """CTE judged(feature_key, seq, accepted): a row-by-row walk along every key."""
    return f"""
c AS (SELECT feature_key, ts, seq, row_number() OVER (PARTITION BY feature_key ORDER BY ts, seq) AS k FROM ({rows})),
walk AS (SELECT feature_key, k, seq, ts AS last, true AS accepted FROM c WHERE k = 1
  UNION ALL SELECT c.feature_key, c.k, c.seq,
    case when c.ts - w.last >= INTERVAL 3 DAY then c.ts else w.last end, c.ts - w.last >= INTERVAL 3 DAY
  FROM walk w JOIN c ON c.feature_key = w.feature_key AND c.k = w.k + 1),
judged AS (SELECT feature_key, seq, accepted FROM walk)"""


ORACLES = {
    "champion_log": oracle("""
SELECT line, "at", seq, flow_version_id, run_id, lag(flow_version_id) OVER w AS previous_version, lag(run_id) OVER w AS previous_run_id
FROM promotions WINDOW w AS (PARTITION BY line ORDER BY "at", seq)""", "promotions"),
    "champion_global_log": oracle("""
SELECT seq, run_id, lag(flow_version_id) OVER w AS previous_version, lag(run_id) OVER w AS previous_run_id
FROM promotions WINDOW w AS (ORDER BY seq)""", "promotions"),
    "champion_current": oracle("""
SELECT line, flow_version_id, run_id, previous_version, previous_run_id FROM (
  SELECT *, lag(flow_version_id) OVER w AS previous_version, lag(run_id) OVER w AS previous_run_id,
         row_number() OVER (PARTITION BY line ORDER BY "at" DESC, seq DESC) AS rn
  FROM promotions WINDOW w AS (PARTITION BY line ORDER BY "at", seq)) WHERE rn = 1""", "promotions"),
    "champion_no_repeats": oracle("""
SELECT line, seq, flow_version_id AS run_id FROM (SELECT *, lag(flow_version_id) OVER (PARTITION BY line ORDER BY "at", seq) AS before FROM promotions)
WHERE before IS NULL OR before <> flow_version_id""", "promotions"),
    "champion_challenge": oracle("""
WITH live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY "at" DESC, seq DESC) AS rn
              FROM promotions WHERE flow_version_id <> 'v0') WHERE rn = 1)
SELECT c_custkey AS line, 'v9' AS version_A, 's' || c_custkey AS model_A, flow_version_id AS version_B, run_id AS model_B,
       run_id IS NULL AS forwarded FROM customer LEFT JOIN live ON line = c_custkey""", "promotions"),
    "promote_job": oracle("""
WITH s AS (SELECT line, seq, "at", round(o_totalprice % 1, 2) AS f FROM promotions),
p AS (SELECT *, lag(f) OVER (PARTITION BY line ORDER BY "at", seq) AS champ FROM s)
SELECT line, seq, round(f - champ, 6) AS margin,
       case when champ IS NULL then 'bootstrap' when f - champ >= 0.01::double then 'promote' else 'keep' end AS decision FROM p""", "promotions"),
    "decide_action": oracle(f"SELECT seq, {_ACTION.format('psi')} AS action FROM measurements", "measurements"),
    "cooldown": oracle("WITH " + _cooldown_sql("SELECT * FROM measurements WHERE psi > 0.10") + " SELECT * FROM judged",
                       "measurements", recursive=True),
    "adaptation_log": oracle(
        "WITH " + _cooldown_sql("SELECT * FROM measurements WHERE psi * 2 > 0.25") + f"""
SELECT m.feature_key, m.seq, case when psi * 2 > 0.25 then 'significant' when psi * 2 > 0.10 then 'moderate' else 'none' end AS band,
       case when j.accepted = false then 'retrain_suppressed_cooldown' else {_ACTION.format('psi * 2')} end AS action
FROM measurements m LEFT JOIN judged j USING (feature_key, seq)""", "measurements", recursive=True),
    "experiment_summary": oracle("""
SELECT experiment_id, version_a || '=' || printf('%.4f', f1_a)
         || case when f1_b IS NULL then '' else ', ' || version_b || '=' || printf('%.4f', f1_b) end AS trained,
       verdict AS drift, 'A/B ' || experiment_id || '-ab-0v1: A=' || printf('%.4f', f1_a) || '  B=' || printf('%.4f', coalesce(f1_b, 0.0))
         || '  -> winner ' || case when f1_a >= coalesce(f1_b, 0.0) then 'A' else 'B' end AS ab FROM experiments""", "experiments"),
    "experiment_batch": oracle("""
SELECT experiment_id || '-ab-0v1' AS ab_test_id, f1_a AS macro_f1_a, coalesce(f1_b, 0.5) AS macro_f1_b,
       case when f1_a >= coalesce(f1_b, 0.5) then 'A' else 'B' end AS winner FROM experiments
UNION ALL SELECT experiment_id || '-ab-1v2', coalesce(f1_b, 0.5), 0.4::double,
       case when coalesce(f1_b, 0.5) >= 0.4 then 'A' else 'B' end FROM experiments""", "experiments"),
}
