from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gaugemill.operators import logistic, textmodel
from gaugemill.operators.textmodel import TooFewRows, TrainingConfig
from gaugemill.plans import experiments, models
from gaugemill.plans.workspace import Workspace, config_version_id

GOOD, BAD = "great helpful relief works", "awful pain worse terrible"
WEAK, STRONG = TrainingConfig(C=0.001, ngram_max=1, min_df=1), TrainingConfig(C=5.0, ngram_max=2, min_df=1)


def _reviews(spark, n, start=0, stretch=1):
    rows = []
    for i in range(start, start + n):
        positive = i % 3 > 0
        words = (GOOD if positive else BAD).split()
        rows.append((i, f"{words[i % 4]} {words[(i + 1) % 4]} filler{i % 7}" * stretch, 9 if positive else 2, "c"))
    df = spark.createDataFrame(rows, "unique_id int, review_text string, rating int, condition string")
    return df.withColumn("review_length", F.length("review_text"))


@pytest.fixture(scope="module")
def data(spark):
    reference = _reviews(spark, 120).cache()
    return SimpleNamespace(reference=reference, training=reference, current=_reviews(spark, 90, 1000).cache())


def test_tfidf_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "Aa bb aa x"), (2, "bb cc")], "d int, t string")
    got = {(r["d"], r["term"]): r["weight"] for r in textmodel.tfidf_weights(df, "d", "t", 1, 1).collect()}
    rare, both = np.log(3 / 2) + 1, np.log(3 / 3) + 1
    first = np.array([2 * rare, both])
    first /= np.linalg.norm(first)
    assert got[(1, "aa")] == pytest.approx(first[0]) and got[(1, "bb")] == pytest.approx(first[1])
    assert set(got) == {(1, "aa"), (1, "bb"), (2, "bb"), (2, "cc")}


def test_terms_are_counted_in_tasks(spark, monkeypatch):
    from gaugemill.operators import termcounts

    monkeypatch.setattr(termcounts, "STEP_WORDS", 5)
    rows = [(1, "aa bb aa bb cc"), (2, "bb aa"), (2, "bb aa"), (3, None), (4, ""), (5, "zz_é 日本 zz_é 日本 x"), (6, "aa")]
    df = spark.createDataFrame(rows, "d int, t string").coalesce(1)
    texts = [[w for w in (t or "").split() if len(w) > 1] for _, t in rows]
    terms = [[" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)] for ws in texts]
    every = {t for ts in terms for t in ts}
    want = {t: (sum(t in ts for ts in terms), sum(ts.count(t) for ts in terms)) for t in every}
    known = textmodel.vocabulary(df, "t", 3, 1)
    assert {r["term"]: (r["df"], r["corpus_tf"]) for r in known.collect()} == want
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # terms leave a task as totals
    got = sorted((r["d"], r["term"], round(r["weight"], 9)) for r in textmodel.tfidf_weights(df, "d", "t", 3, 1).collect())
    idf = {t: np.log((len(rows) + 1) / (n + 1)) + 1 for t, (n, _) in want.items()}
    expected = []
    for (d, _), ts in zip(rows, terms, strict=True):
        raw = {t: ts.count(t) * idf[t] for t in set(ts)}
        length = np.sqrt(sum(x * x for x in raw.values()))
        expected += [(d, t, round(x / length, 9)) for t, x in raw.items()]
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in sorted(expected)])


def test_ngrams(spark):
    df = spark.createDataFrame([("one two three",), ("one",), ("",)], "t string")
    got = [r[0] for r in df.select(textmodel.ngrams(textmodel.words(F.col("t")), 3)).collect()]
    assert got == [["one", "two", "three", "one two", "two three", "one two three"], ["one"], []]


def test_logistic_optimum_equals_newton(spark, data):
    config = TrainingConfig(C=0.7, ngram_max=1, min_df=1)
    rows = models.splits.text_and_label(models.splits.sentiment_rows(data.reference))
    model = textmodel.fit(config, rows, min_rows=10)
    staged = model.transform(rows).select("_features", "sentiment").collect()
    x = np.array([r["_features"].toArray() for r in staged])
    y = np.array([r["sentiment"] for r in staged], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = config.C * design.T @ (weight * (p - y)) + penalty @ beta
        hessian = config.C * (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(beta[:-1], abs=1e-4)
    assert model.stages[-1].intercept == pytest.approx(beta[-1], abs=1e-4)


def test_min_rows_guard(spark, data, tmp_path):
    with pytest.raises(TooFewRows):
        models.train(Workspace(spark, str(tmp_path)), STRONG, data.training, data.current)


def test_select_ab_promote_and_adapt(spark, data, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    weak, strong = (models.train(ws, c, data.training, data.current, 50) for c in (WEAK, STRONG))
    assert ws.latest_model() == strong and models.ensure_model(ws, WEAK, data.training, data.current, 50) == strong
    chosen = models.select_best(ws, {"weak": WEAK, "strong": STRONG}, data.current)
    scores = {r["candidate"]: r["macro_f1"] for r in
              models.score_models(ws, {"weak": weak, "strong": strong},
                                  models.splits.text_and_label(models.splits.sentiment_rows(data.current))).collect()}
    assert chosen["macro_f1"] == max(scores.values())
    assert models.champion_challenge(ws, data.current, "t0") is None  # nothing live yet: forwarded
    assert models.promote(ws, "unused", data.current)["promoted"]
    assert ws.champion()["run_id"] == chosen["run_id"]

    measured = models.ab_flow(ws, config_version_id(WEAK), config_version_id(STRONG), data.current, "t1")
    assert measured["n_A"] + measured["n_B"] == 90

    drifted = SimpleNamespace(reference=data.reference, training=data.training, current=_reviews(spark, 90, 1000, 9))
    calm = SimpleNamespace(reference=data.reference, training=data.training, current=data.reference)
    assert models.adapt(ws, calm, now=0.0)["action"] == "none"
    acted = models.adapt(ws, drifted, STRONG, now=10_000.0, min_rows=50, check_quality=False)
    assert acted["action"] == "retrain" and acted["band"] == "significant"
    held = models.adapt(ws, drifted, STRONG, now=13_599.0, min_rows=50, check_quality=False)
    assert held["action"] == "retrain_suppressed_cooldown"
    assert ws.table("adaptation_log").count() == 3


def test_experiment_spec_and_summary(spark, data, tmp_path):
    spec = experiments.ExperimentSpec("exp-rt", (WEAK, STRONG), ((0, 1),))
    assert experiments.read_specs(spark.createDataFrame([(spec.to_json(),)], "value string")) == [spec]
    ws = Workspace(spark, str(tmp_path))
    result = experiments.run_experiment(ws, spec, data, 50)
    line = experiments.summarize(experiments.parse_results(spark.read.parquet(ws.path("experiment_results")))).first()
    assert line["trained"].startswith(f"{config_version_id(WEAK)}={result['trained'][0]['eval_macro_f1']:.4f}, ")
    assert line["ab"].endswith(f"-> winner {result['ab_results'][0]['winner']}")
    assert ws.runs().where("experiment like 'exp-rt:%'").count() == 4


def _optimum(x, y, weight, penalty):
    """Minimum of the weighted mean loss plus the penalty, by Newton steps; the last entry is the intercept."""
    design, beta = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) / weight.sum() + ridge @ beta
        beta -= np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design / weight.sum() + ridge, gradient)
    return beta


def test_logistic_fit_of_frequent_and_rare_features(spark, monkeypatch):
    """Features from everywhere to in two rows, rows without any: the optimum to six digits in few passes."""
    rng = np.random.default_rng(3)
    x = rng.random((2500, 40)) * (rng.random((2500, 40)) < np.geomspace(0.9, 0.001, 40))
    x[::50] = 0
    y, weight = (rng.random(2500) < 0.2 + 0.6 * (x[:, 0] > 0.5)).astype(float), rng.integers(1, 4, 2500).astype(float)
    rows = [(Vectors.sparse(40, [(j, v) for j, v in enumerate(r) if v]), float(a), float(b)) for r, a, b in zip(x, y, weight)]
    df = spark.createDataFrame(rows, ["v", "y", "w"]).repartition(5)
    passes, summed = [], logistic.summed
    monkeypatch.setattr(logistic, "summed", lambda *given: passes.append(0) or summed(*given))
    coefficients, intercept = logistic.fit(df, 40, 1e-4, "v", "y", "w")
    assert np.append(coefficients, intercept) == pytest.approx(_optimum(x, y, weight, 1e-4), abs=2e-5)
    assert len(passes) < 120


def test_fit_sends_the_driver_one_vector_a_pass(spark, data, monkeypatch):
    """Terms in many partitions: sums are finished by the tasks, whose results are slices of one vector."""
    monkeypatch.setattr(logistic, "_SLICE", 4)
    rows = models.splits.text_and_label(models.splits.sentiment_rows(data.reference))
    one, many = (textmodel.fit(STRONG, rows.repartition(n), min_rows=10) for n in (1, 9))
    by_term = [dict(zip(m.stages[-4].vocabulary, m.stages[-1].coefficients)) for m in (one, many)]
    assert len(by_term[0]) > 8 and by_term[0] == pytest.approx(by_term[1], abs=1e-6)
    vector = [np.arange(9.0)]
    found = logistic.summed(spark.sparkContext.parallelize(range(6), 6), 9, lambda k: vector[0] * k)
    assert found.tolist() == (np.arange(9.0) * 15).tolist()


def test_fit_on_one_class_has_no_coefficients(spark, data):
    rows = models.splits.text_and_label(models.splits.sentiment_rows(data.reference)).where("sentiment = 1")
    fitted = textmodel.fit(STRONG, rows, min_rows=10).stages[-1]
    assert not fitted.coefficients.toArray().any() and fitted.intercept == float("inf")


def test_vocabulary_of_a_fit_breaks_ties_by_term(spark):
    df = spark.createDataFrame([("bb aa cc dd dd", 1), ("aa bb cc", 0)], "review_text string, sentiment int")
    model = textmodel.fit(TrainingConfig(ngram_max=1, min_df=1), df, min_rows=1, max_features=3)
    assert model.stages[-4].vocabulary == ["aa", "bb", "cc"]
