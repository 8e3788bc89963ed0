import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import lifecycle, tracking, versions
from gaugemill.operators.textmodel import TrainingConfig
from gaugemill.plans.workspace import NoChampion, Workspace, config_version_id

GOLDEN = {"baseline": "dfda8c64c3e3", "challenger": "e39940d83d56", "c03": "77e01c5e46e1"}


def test_golden_config_ids(spark):
    rows = [(n, float(p["C"]), p["ngram_max"], p["min_df"], 7, 4, 0) for n, p in versions.PRESETS.items()]
    df = spark.createDataFrame(rows, "name string, c double, g int, m int, f int, l int, s int")
    got = df.select("name", versions.config_version(*[F.col(x) for x in "cgmfls"]).alias("v")).collect()
    assert {r["name"]: r["v"] for r in got} == GOLDEN
    assert {n: config_version_id(TrainingConfig(**p)) for n, p in versions.PRESETS.items()} == GOLDEN


def test_versions_follow_content(spark):
    def dataset(*pairs):
        return versions.dataset_version(spark.createDataFrame(list(pairs), "name string, digest string")).first()[0]

    assert dataset(("train.csv", "aaa"), ("test.csv", "bbb")) == dataset(("test.csv", "bbb"), ("train.csv", "aaa"))
    assert dataset(("train.csv", "aaa"), ("test.csv", "bbb")) != dataset(("train.csv", "aaa"), ("test.csv", "ccc"))
    one, two, three = spark.range(1).select(
        versions.prep_version(F.lit("dataset-aaa")), versions.prep_version(F.lit("dataset-bbb")),
        versions.prep_version(F.lit("dataset-aaa"), {**versions.PREP_PARAMS, "rating_bucket_bins": [0, 5, 10]}),
    ).first()
    assert len({one, two, three}) == 3


def test_table_digest_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "a int, b string")
    digest = versions.table_digest(df.repartition(7)).first()
    assert digest == versions.table_digest(df.orderBy(F.desc("a"))).first()
    assert digest != versions.table_digest(df.withColumn("b", F.when(F.col("a") != 5, F.col("b")))).first()


def _greedy(times, seconds):
    last, out = None, []
    for t in times:
        ok = last is None or (t - last).total_seconds() >= seconds
        out.append(ok)
        last = t if ok else last
    return out


@pytest.mark.parametrize("seed,seconds,block", [(0, 100, 1), (1, 37, 3), (2, 5000, 8)])
def test_cooldown_equals_row_by_row(spark, seed, seconds, block):
    rng, base = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for key, n, span in (("hot", 900, 40000), ("thin", 20, 400000), ("same", 12, 3), ("one", 1, 1)):
        for t in sorted(rng.randrange(span) for _ in range(n)):
            rows.append((key, base + timedelta(seconds=t), len(rows)))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, s long").repartition(3)
    got = {r["s"]: r["accepted"] for r in lifecycle.cooldown(df, "k", "t", "s", seconds, block).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        expected.update(zip((r[2] for r in mine), _greedy([r[1] for r in mine], seconds)))
    assert got == expected


def test_cooldown_of_one_long_history_goes_up_a_tree(spark, monkeypatch):
    rng, base, held, write = random.Random(9), datetime(2024, 1, 1), [], lifecycle.stage
    monkeypatch.setattr(lifecycle, "stage", lambda df, name: held.append(write(df, name)) or held[-1])
    times = sorted(rng.randrange(200_000) for _ in range(6000))
    df = spark.createDataFrame([("all", base + timedelta(seconds=t), i) for i, t in enumerate(times)], "k string, t timestamp_ntz, s long")
    got = {r["s"]: r["accepted"] for r in lifecycle.cooldown(df, "k", "t", "s", 90, 2, 4).collect()}
    assert got == dict(enumerate(_greedy([base + timedelta(seconds=t) for t in times], 90)))
    sizes = [level.count() for level in held]
    assert len(sizes) > 4 and sizes[-1] == 1 and all(b <= a // 4 + 2 for a, b in zip(sizes, sizes[1:]))
    # a function over many blocks is no longer than one over a single block may be
    assert max(r["n"] for level in held for r in level.selectExpr("size(upto) as n").collect()) <= 92


def test_champion_pointer(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    assert ws.champion() is None and ws.rollback() is None
    with pytest.raises(NoChampion):
        ws.require_champion()
    ws.set_champion("v1", "r1")
    assert ws.champion()["previous_run_id"] is None
    ws.set_champion("v2", "r2")
    ws.set_champion("v2", "r2")  # live already
    ws.set_champion("v3", "r3")
    assert (ws.champion()["run_id"], ws.champion()["previous_run_id"]) == ("r3", "r2")
    assert ws.rollback()["run_id"] == "r2"
    assert ws.champion()["previous_run_id"] == "r3"


def test_tracking_and_artifacts(spark, tmp_path):
    plain, scoped = Workspace(spark, str(tmp_path)), Workspace(spark, str(tmp_path), "exp-42", "fr-001")
    first = plain.log("base", "a", tags={"flow_version_id": "v"})
    second = plain.log("base", "b", params={"C": 1.0}, metrics={"f1": 0.5}, tags={"flow_version_id": "v"})
    third = scoped.log("base", "c", tags={"flow_version_id": "v"})
    assert first != second
    assert tracking.resolve(plain.runs(), "base", "v") == second
    assert tracking.resolve(plain.runs(), "exp-42:base", "v") == third
    assert plain.runs().where(F.col("run_id") == third).first()["tags"]["flow_run_id"] == "fr-001"
    with pytest.raises(tracking.NotRecorded):
        tracking.resolve(plain.runs(), "base", "w")
    plain.write_artifact("ab/winner", {"x": 1})
    plain.write_artifact("ab/winner", {"x": 2})
    assert plain.read_artifact("ab/winner") == {"x": 2}
    with pytest.raises(FileNotFoundError):
        scoped.read_artifact("ab/winner")
