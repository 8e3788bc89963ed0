import pytest
from pyspark.sql import functions as F

from gaugemill.operators import evaluation, lifecycle, ordered, splits


def test_assembly_is_a_partition(spark):
    reference = spark.createDataFrame([(1,)], "unique_id int")
    incoming = spark.createDataFrame([(i,) for i in range(10, 400)], "unique_id int")
    training, current = splits.assemble_splits(reference, incoming, True)
    t, c = {r[0] for r in training.collect()}, {r[0] for r in current.collect()}
    assert t & c == set() and t | c == {1, *range(10, 400)} and 1 in t
    same_training, same_current = splits.assemble_splits(reference, incoming, False)
    assert same_training is reference and same_current is incoming


def test_sentiment_rows(spark):
    df = spark.createDataFrame([(r,) for r in range(1, 11)], "rating int")
    assert [(r[0], r[1]) for r in splits.sentiment_rows(df).orderBy("rating").collect()] == [
        (1, 0), (2, 0), (3, 0), (4, 0), (7, 1), (8, 1), (9, 1), (10, 1)]


def test_capped_sample_does_not_depend_on_partitions(spark):
    one = splits.capped_sample(spark.range(1000).repartition(7), "id", 50).collect()
    two = splits.capped_sample(spark.range(1000).repartition(2), "id", 50).collect()
    assert sorted(one) == sorted(two) and len(one) == 50


def test_macro_f1_counts_predicted_only_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "y int, p int")
    row = evaluation.scores(df, "y", "p").first()
    assert row["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0.0) / 3)
    assert (row["n"], row["majority_class"]) == (4, 0)
    assert row["majority_macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_winner_ties(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "candidate string, macro_f1 double")
    assert evaluation.pick_winner(df).first()["candidate"] == "a"
    ab = spark.createDataFrame([("A", 5, 0.7), ("B", 6, 0.7)], "variant string, n bigint, macro_f1 double")
    assert evaluation.ab_measure(ab).first()["winner"] == "A"


@pytest.fixture(scope="module")
def hot(spark):
    """One group owns most rows, with values repeated across cuts."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"),
        "id", (F.col("id") * 7919 % 3001).alias("o"),
    ).repartition(5)


def _plain(frame):
    frame.createOrReplaceTempView("plain_rows")
    return sorted(map(tuple, frame.sparkSession.sql(
        "select g, id, o, row_number() over (partition by g order by o, id) n, lag(id) over (partition by g order by o, id) before from plain_rows"
    ).collect()), key=repr)


@pytest.mark.parametrize("kind", ["hot", "burst", "few order values", "null group", "one group"])
def test_ordered_columns_equal_plain_windows(spark, hot, kind):
    rows = {
        "hot": hot,
        "burst": hot.withColumn("g", F.when(F.col("o").between(1000, 1299), "burst").otherwise(F.col("g"))),
        "few order values": hot.withColumn("o", F.col("o") % 3),
        "null group": hot.withColumn("g", F.when(F.col("g") != "hot", F.col("g"))),
        "one group": hot.withColumn("g", F.lit("all")),
    }[kind]
    numbered = ordered.with_row_number(rows, ["g"], ["o", "id"], "n", range_rows=200)
    both = ordered.with_previous(numbered, ["g"], ["o", "id"], {"before": "id"}, range_rows=200)
    assert sorted(map(tuple, both.select("g", "id", "o", "n", "before").collect()), key=repr) == _plain(rows)


@pytest.mark.parametrize("order", [["o"], ["o3", "id"]])
def test_no_range_holds_much_more_than_it_should(hot, order):
    rows = hot.withColumn("o3", F.col("o") % 3).withColumn("g", F.when(F.col("o").between(1000, 1299), "burst").otherwise(F.col("g")))
    sizes = [r["count"] for r in ordered.in_ranges(rows, ["g", *order], 200).groupBy("_range").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 500


def test_whole_table_as_one_group(hot):
    numbered = ordered.with_row_number(hot, [], ["o"], "n", range_rows=300)
    rows = sorted(numbered.collect(), key=lambda r: r["o"])
    assert [r["n"] for r in rows] == list(range(1, 3001))


def test_running_totals(spark, hot):
    got = ordered.running_totals(hot, "o", {"upto": "id"}, range_rows=400)
    total = 0
    for row in sorted(got.collect(), key=lambda r: r["o"]):
        total += row["id"]
        assert row["upto"] == total and row["all_upto"] == sum(range(3000))


def test_margins(spark):
    rows = spark.createDataFrame([(0.80, 0.82), (0.80, 0.805), (None, 0.3)], "champion_macro_f1 double, candidate_macro_f1 double")
    assert [r["decision"] for r in lifecycle.promotion_decision(rows).collect()] == ["promote", "keep", "bootstrap"]
