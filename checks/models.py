"""Text-model queries on labelled documents.

Trained coefficients have no SQL equivalent, so most of these are checked by pytest and by
row presence; the TF-IDF tables behind them are compared with SQL.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from checks.views import oracle, table, view
from gaugemill.operators import evaluation, splits, textmodel
from gaugemill.operators.quality import GateFailed, ks_statistic
from gaugemill.operators.textmodel import TrainingConfig
from gaugemill.plans import experiments, models
from gaugemill.plans.workspace import Workspace, config_version_id
from gaugemill.session import scratch_path

# The labelled stand-in is a tenth of a review table, and so is the guard on its size.
_MIN_ROWS = 50
# Labels do not follow from these texts, so no model is ever nine tenths sure of them.
_SURE = 0.6
_FIRST = TrainingConfig(C=1.0, ngram_max=2, min_df=5)
_SECOND = TrainingConfig(C=0.05, ngram_max=1, min_df=20)
_kept: dict[tuple[int, str], SimpleNamespace] = {}


def _data(spark, sf):
    """Prepared splits and two trained candidates, made once per session and data set."""
    key = (id(spark.sparkContext), sf)
    if key not in _kept:
        ws = Workspace(spark, scratch_path(spark, "models"))
        raw = view(spark, sf, "labelled_reviews")
        parts = {}
        for split in ("reference", "current"):
            path = ws.path(f"processed/{split}")
            splits.prepare_split(raw.where(F.col("split") == split), split).write.parquet(path)
            parts[split] = spark.read.parquet(path)
        data = SimpleNamespace(reference=parts["reference"], training=parts["reference"], current=parts["current"])
        runs = {
            name: models.train(ws, config, data.training, data.current, _MIN_ROWS)
            for name, config in (("first", _FIRST), ("second", _SECOND))
        }
        rows = splits.text_and_label(splits.sentiment_rows(data.current))
        _kept[key] = SimpleNamespace(ws=ws, data=data, runs=runs, rows=rows, model=models.load_model(ws, runs["first"]))
    return _kept[key]


def tfidf_vocabulary(spark, sf):
    return textmodel.vocabulary(table(spark, sf, "documents"), "text", 2).withColumn("idf", F.round("idf", 9))


def tfidf(spark, sf):
    weights = textmodel.tfidf_weights(table(spark, sf, "documents"), "doc_id", "text", 2, 5)
    return weights.withColumn("weight", F.round("weight", 9))


def min_rows_guard(spark, sf):
    rows = splits.sentiment_rows(view(spark, sf, "reviews_raw"))
    return rows.agg(F.count("*").alias("rows")).withColumn("passed", F.col("rows") >= 1000)


def train_logreg(spark, sf):
    """Coefficient of every vocabulary term."""
    model = _data(spark, sf).model
    terms = model.stages[-4].vocabulary
    weights = [float(w) for w in model.stages[-1].coefficients]
    return spark.createDataFrame(list(zip(terms, weights)), "term string, coefficient double")


def train_job(spark, sf):
    return _data(spark, sf).ws.runs().select(
        "run_name", "experiment", F.col("metrics")["train_macro_f1"].alias("train_macro_f1"),
        F.col("metrics")["eval_macro_f1"].alias("eval_macro_f1"), F.col("tags")["flow_version_id"].alias("version"),
    )


def train_versioned(spark, sf):
    kept = _data(spark, sf)
    models.train_versioned(kept.ws, _SECOND, _steady(kept), _MIN_ROWS)
    return spark.read.parquet(kept.ws.path("artifacts")).select("name", "payload")


def _steady(kept):
    """Splits that pass the quality gates: the current one is spread as the reference is."""
    return SimpleNamespace(reference=kept.data.reference, training=kept.data.training, current=kept.data.reference)


def quality_gate_stops_training(spark, sf):
    """The current split's ratings differ from the reference, which the first gate must say."""
    kept = _data(spark, sf)
    try:
        models.train_versioned(kept.ws, _SECOND, kept.data, _MIN_ROWS)
        said = None
    except GateFailed as failed:
        said = str(failed)
    ks = ks_statistic(kept.data.reference.select("rating", F.lit(True).alias("ref")).unionByName(
        kept.data.current.select("rating", F.lit(False).alias("ref"))), "rating", "ref")
    return ks.select((F.col("ks") > 0.02).alias("must_stop"), F.lit(said is not None).alias("stopped"))


def model_store(spark, sf):
    """A stored model reloaded: rows on which it disagrees with the one in memory."""
    kept = _data(spark, sf)
    again = models.load_model(kept.ws, kept.runs["first"])
    both = textmodel.predict(again, textmodel.predict(kept.model, kept.rows, "before", "_b"), "after", "_a")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("different"))


def model_catalog(spark, sf):
    return _data(spark, sf).ws.models().select(
        "run_id", "flow_version_id", "training_rows", "evaluation_rows",
        F.to_json("flow_config").alias("config"), F.to_json("metrics").alias("metrics"),
    )


def ensure_model(spark, sf):
    kept = _data(spark, sf)
    found = models.ensure_model(kept.ws, _FIRST, kept.data.training, kept.data.current, _MIN_ROWS)
    return kept.ws.models().where(F.col("run_id") == found).select("run_id", "flow_version_id")


def batch_predict(spark, sf):
    kept = _data(spark, sf)
    return textmodel.predict(kept.model, kept.rows).select("unique_id", "sentiment", "prediction", "probabilities")


def confident_sample(spark, sf):
    kept = _data(spark, sf)
    return textmodel.confident_sample(textmodel.predict(kept.model, kept.rows), "unique_id", above=_SURE).select(
        "unique_id", "prediction", "probabilities")


def negation_shift(spark, sf):
    kept = _data(spark, sf)
    return textmodel.negation_check(kept.model, textmodel.predict(kept.model, kept.rows), "unique_id", above=_SURE)


def invariance_agreement(spark, sf):
    kept = _data(spark, sf)
    return textmodel.invariance_agreement(kept.model, textmodel.predict(kept.model, kept.rows), "unique_id")


def champion_score(spark, sf):
    """Every current row scored by the promoted model."""
    kept = _data(spark, sf)
    live = kept.ws.champion() or kept.ws.set_champion(config_version_id(_FIRST), kept.runs["first"])
    return textmodel.champion_score(models.load_model(kept.ws, live["run_id"]), kept.rows).select("unique_id", "label", "prob")


def model_margin(spark, sf):
    kept = _data(spark, sf)
    return evaluation.baseline_margin(textmodel.predict(kept.model, kept.rows), "sentiment", "prediction")


def select_job(spark, sf):
    kept = _data(spark, sf)
    models.select_best(kept.ws, {"first": _FIRST, "second": _SECOND}, kept.data.current)
    return kept.ws.runs().where("run_name = 'selection'").select(F.to_json("metrics").alias("metrics"), F.to_json("params").alias("params"))


def ab_job(spark, sf):
    kept = _data(spark, sf)
    found = models.ab_flow(kept.ws, config_version_id(_FIRST), config_version_id(_SECOND), kept.data.current, "ab-check")
    return spark.createDataFrame([found], "n_A bigint, macro_f1_A double, n_B bigint, macro_f1_B double, winner string")


def promotion_run(spark, sf):
    """Selection, A/B test against the champion and promotion, end to end."""
    kept = _data(spark, sf)
    models.select_best(kept.ws, {"first": _FIRST, "second": _SECOND}, kept.data.current)
    models.champion_challenge(kept.ws, kept.data.current, "promotion-check")
    models.promote(kept.ws, config_version_id(_FIRST), kept.data.current)
    return spark.read.parquet(kept.ws.path("champions"))


def adaptation_job(spark, sf):
    """The closed loop on a current segment whose lengths have drifted."""
    kept = _data(spark, sf)
    drifted = _steady(kept).current.withColumn("review_length", F.col("review_length") * 20)
    data = SimpleNamespace(reference=kept.data.reference, training=kept.data.training, current=drifted)
    for now in (1_000_000.0, 1_000_100.0):
        models.adapt(kept.ws, data, _SECOND, "adapt-check", now, min_rows=_MIN_ROWS)
    return spark.read.parquet(kept.ws.path("adaptation_log")).drop("seq")


def experiment_run(spark, sf):
    """One experiment: two configs, drift check and their A/B pair, summarized from its document."""
    kept = _data(spark, sf)
    spec = experiments.ExperimentSpec("exp-check", (_FIRST, _SECOND), ((0, 1),))
    experiments.run_experiment(kept.ws, spec, kept.data, _MIN_ROWS)
    return experiments.summarize(experiments.parse_results(spark.read.parquet(kept.ws.path("experiment_results"))))


QUERIES = {
    f.__name__: f
    for f in (tfidf_vocabulary, tfidf, min_rows_guard, train_logreg, train_job, train_versioned, quality_gate_stops_training, model_store, model_catalog,
              ensure_model, batch_predict, confident_sample, negation_shift, invariance_agreement, champion_score,
              model_margin, select_job, ab_job, promotion_run, adaptation_job, experiment_run)
}

_TERMS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM documents),
t AS (SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM w),
counts AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
vocab AS (SELECT term, count(*) AS df, cast(sum(tf) AS bigint) AS corpus_tf FROM counts GROUP BY term HAVING count(*) >= 5
          ORDER BY corpus_tf DESC, term LIMIT 100000),
v AS (SELECT *, ln(((SELECT count(*) FROM documents) + 1)::double / (df + 1)) + 1 AS idf FROM vocab)
"""
ORACLES = {
    "tfidf_vocabulary": _TERMS + "SELECT term, df, corpus_tf, round(idf, 9) AS idf FROM v",
    "tfidf": _TERMS + """, raw AS (SELECT doc_id, term, tf * idf AS r FROM counts JOIN v USING (term))
SELECT doc_id, term, round(r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw""",
    "min_rows_guard": oracle("SELECT count(*) AS rows, count(*) >= 1000 AS passed FROM reviews_raw WHERE rating >= 7 OR rating <= 4", "reviews_raw"),
}
