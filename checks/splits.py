"""Hash splits, routing, assembly and deterministic samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning import _PREPARED
from checks.views import oracle, table, view
from gaugemill.functions.hashing import ab_variant, hash_position, is_holdout
from gaugemill.operators import splits


def _fold(text: str) -> str:
    """SQL for a 256-bit digest modulo 10000, limb by limb."""
    h = f"sha256({text})"
    acc = "0"
    for limb in range(8):
        acc = f"(({acc} * 4294967296 + ('0x' || substr({h}, {8 * limb + 1}, 8))::bigint) % 10000)"
    return acc


def _variant(text: str) -> str:
    return f"case when ('0x' || right(sha256({text}), 1))::bigint % 2 = 0 then 'A' else 'B' end"


def holdout_split(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(hash_position(F.col("o_orderkey"), "incoming-holdout"), 4).alias("position"),
        is_holdout(F.col("o_orderkey")).alias("held_out"),
    )


def ab_assign(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", ab_variant(F.col("o_orderkey"), "drug-sentiment-ab-001").alias("variant")
    )


def route_segment(spark, sf):
    current = view(spark, sf, "reviews_raw").where("split = 'current'").withColumnRenamed("uniqueID", "unique_id")
    return splits.route_segment(current, "ab-7").select("unique_id", "rating", "sentiment", "variant")


def _prepared(spark, sf):
    raw = view(spark, sf, "reviews_raw")
    return (
        splits.prepare_split(raw.where("split = 'reference'"), "reference"),
        splits.prepare_split(raw.where("split = 'current'"), "current"),
    )


def assemble_splits(spark, sf):
    training, current = splits.assemble_splits(*_prepared(spark, sf), True)
    keep = ("unique_id", "split", "review_length")
    return training.select(*keep, F.lit("training").alias("part")).unionByName(
        current.select(*keep, F.lit("current").alias("part"))
    )


def combine_sort(spark, sf):
    return splits.combine_sort(*_prepared(spark, sf))


def segment_scan(spark, sf):
    """The unseen segment: only its own columns and rows reach the aggregate."""
    return (
        view(spark, sf, "reviews_raw").where("split = 'current'")
        .groupBy("drugName").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))
    )


def capped_sample(spark, sf):
    return splits.capped_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3000)


def head_n(spark, sf):
    return splits.head_n(table(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 50)


QUERIES = {
    f.__name__: f
    for f in (holdout_split, ab_assign, route_segment, assemble_splits, combine_sort, segment_scan, capped_sample, head_n)
}

_HELD = f"{_fold(chr(39) + 'incoming-holdout:' + chr(39) + ' || unique_id')} / 10000.0 < 0.3"
ORACLES = {
    "holdout_split": f"""
SELECT o_orderkey, round(p / 10000.0::double, 4) AS position, p / 10000.0::double < 0.3::double AS held_out
FROM (SELECT o_orderkey, {_fold("'incoming-holdout:' || o_orderkey")} AS p FROM orders)""",
    "ab_assign": f"SELECT o_orderkey, {_variant(chr(39) + 'drug-sentiment-ab-001:' + chr(39) + ' || o_orderkey')} AS variant FROM orders",
    "route_segment": oracle(f"""
SELECT uniqueID AS unique_id, rating, cast(case when rating >= 7 then 1 else 0 end AS tinyint) AS sentiment,
       {_variant("'ab-7:' || uniqueID")} AS variant
FROM reviews_raw WHERE split = 'current' AND (rating >= 7 OR rating <= 4)""", "reviews_raw"),
    "assemble_splits": oracle(f"""
WITH p AS ({_PREPARED}), h AS (SELECT unique_id, split, review_length, {_HELD} AS held FROM p)
SELECT unique_id, split, review_length, 'training' AS part FROM h WHERE split = 'reference' OR NOT held
UNION ALL SELECT unique_id, split, review_length, 'current' FROM h WHERE split = 'current' AND held""", "reviews_raw"),
    "combine_sort": oracle(_PREPARED, "reviews_raw"),
    "segment_scan": oracle(
        "SELECT drugName, count(*) AS n, cast(sum(rating) AS bigint) AS ratings FROM reviews_raw WHERE split = 'current' GROUP BY 1",
        "reviews_raw"),
    "capped_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('0:' || o_orderkey), o_orderkey LIMIT 3000",
    "head_n": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50",
}
