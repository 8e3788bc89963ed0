import hashlib
import html
import json
import random

import pytest
from pyspark.sql import functions as F

from gaugemill.functions import canonical, columns, hashing, text

NASTY = [
    None, "", "   ", "plain words", "a b　c", "x\u001cy\u001dz", "&amp;quot; &copy=1 &nbsp;caf&eacute;",
    "\t tab\nline\r\n", "&#39;q&#39; &notin; &lt", "one two\u0085three", "\U0001f600 smile", "'both' \"kinds\"",
    "it's", 'say "x"', "back\\slash", "zero​width", "\x07bell", "a" * 500,
]


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(list(enumerate(NASTY)), "id long, t string").repartition(3)


def _by_id(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}


def test_clean_text_and_counts_match_python(nasty):
    df = nasty.select("id", text.clean_text(F.col("t")).alias("c")).select(
        "id", "c", F.length("c").alias("n"), text.word_count(F.col("c")).alias("w")
    )
    for row in df.collect():
        raw = NASTY[row["id"]]
        expected = " ".join(("" if raw is None else html.unescape(raw)).split())
        assert (row["c"], row["n"], row["w"]) == (expected, len(expected), len(expected.split()))


ENTITIES = [
    "&", "&&amp;&amp;&", "a&lt;", "&lt;b", "&notit; &notin;x", "&#0;&#x80;&#xD800;&#1114112;&#1;", "&#x41&#65 &#x;", "&unknown; &;",
    "& amp;", "&amp\n;", "&" + "n" * 40 + ";", "&ngE;&nvlt;", "\U0001f600&\U0001f600;&copy", "&amp;lt;", "x&#38;#65;y", "&\r;&am p;",
]


def test_decode_entities_equals_python(spark):
    rows = spark.createDataFrame([*enumerate([*ENTITIES, None, "".join(ENTITIES)])], "id long, t string").repartition(3)
    for row in rows.select("t", text.decode_entities(F.col("t")).alias("d")).collect():
        assert row["d"] == (None if row["t"] is None else html.unescape(row["t"]))


def test_decode_entities_sends_python_no_text(spark):
    """A long text with one reference: Python sees the reference only."""
    rows = spark.range(200).select(F.concat(F.lit("a&lt;b"), F.repeat(F.lit("word "), 4000)).alias("t"))
    decoded = rows.select(text.decode_entities(F.col("t")).alias("d"))
    assert {r["d"] for r in decoded.collect()} == {"a<b" + "word " * 4000}
    sent, nodes = 0, [decoded._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        metric = node.metrics().get("pythonDataSent")
        sent += metric.get().value() if metric.isDefined() else 0
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert 0 < sent < 200 * 1000


def test_python_repr(nasty):
    shown = _by_id(nasty.where("t is not null").select("id", text.python_repr(F.col("t")).alias("r")), "r")
    assert all(value == repr(NASTY[i]) for i, value in shown.items())


def test_perturbations(nasty):
    rows = nasty.where("t is not null")
    dots = _by_id(rows.select("id", text.perturb(F.col("t"), "trailing_period").alias("p")), "p")
    assert all(v == NASTY[i].rstrip(".") + "." for i, v in dots.items())
    swapped = rows.select("id", text.perturb(F.col("t"), "char_swap", F.col("id")).alias("p"))
    first = _by_id(swapped, "p")
    again = _by_id(nasty.where("t is not null").repartition(1).select("id", text.perturb(F.col("t"), "char_swap", F.col("id")).alias("p")), "p")
    assert first == again
    assert all(sorted(v) == sorted(NASTY[i]) for i, v in first.items())
    assert first[1] == ""
    with pytest.raises(ValueError):
        text.perturb(F.col("t"), "shout")


def test_negation_prefix_cycles(spark):
    rows = spark.range(5).select("id", text.negation_prefix(F.lit("x"), F.col("id")).alias("n"))
    assert [r["n"] for r in rows.orderBy("id").collect()] == [
        "I disagree, x", "Not really - x", "On the contrary, x", "I disagree, x", "Not really - x"]


def test_format_prediction(spark):
    line = spark.range(1).select(
        text.format_prediction(F.lit("great drug"), F.lit(1), F.lit(0.9312), F.lit("run-xyz"), F.lit("ver-abc"))
    ).first()[0]
    assert line == "label=1 (positive) prob=0.9312 champion=run-xyz version=ver-abc | 'great drug'"
    odd = spark.range(1).select(
        text.format_prediction(F.lit("x"), F.lit(0), F.lit(0.00015), F.lit("r"), F.lit("v"))).first()[0]
    assert f"prob={0.00015:.4f}" in odd


def test_dates(spark):
    df = spark.createDataFrame([("20-May-99",), ("3-Feb-12",), ("03-feb-12",), ("1-Jan-69",), ("31-Dec-68",)], "d string")
    got = [str(r[0].date()) for r in df.select(columns.parse_date(F.col("d"))).collect()]
    assert got == ["1999-05-20", "2012-02-03", "2012-02-03", "1969-01-01", "2068-12-31"]
    bad = spark.createDataFrame([("2012-02-03",)], "d string")
    assert bad.select(columns.try_parse_date(F.col("d"))).first()[0] is None
    with pytest.raises(Exception):
        bad.select(columns.parse_date(F.col("d"))).collect()


def test_rating_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.0, 4.5, 7.0, 7.1, 10.0, 11.0)], "r double")
    assert [r[0] for r in df.select(columns.rating_bucket(F.col("r"))).collect()] == [
        None, "low", "low", "medium", "medium", "high", "high", None]


def test_required_raises_on_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(Exception, match="null in x"):
        df.select(columns.required(F.col("x"), "smallint", "x")).collect()


def test_hash_positions_match_hashlib(spark):
    df = spark.range(2000).select(
        "id", hashing.hash_position(F.col("id"), "incoming-holdout").alias("p"), hashing.ab_variant(F.col("id"), "t").alias("v")
    )
    for r in df.collect():
        place = int(hashlib.sha256(f"incoming-holdout:{r['id']}".encode()).hexdigest(), 16) % 10000 / 10000
        even = int(hashlib.sha256(f"t:{r['id']}".encode()).hexdigest(), 16) % 2 == 0
        assert r["p"] == place and r["v"] == ("A" if even else "B")


def test_split_shares_and_salt(spark):
    ids = spark.range(20000)
    share = ids.select(F.avg(hashing.is_holdout(F.col("id")).cast("int"))).first()[0]
    assert 0.28 < share < 0.32
    moved = ids.select(F.avg((hashing.ab_variant(F.col("id"), "a") != hashing.ab_variant(F.col("id"), "b")).cast("int"))).first()[0]
    assert 0.4 < moved < 0.6
    assert ids.where(hashing.is_holdout(F.col("id"), 0.0)).count() == 0
    assert ids.where(hashing.is_holdout(F.col("id"), 1.0)).count() == 20000


def test_canonical_numbers(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, 1e-5, 5e-4, 1e-4, 0.05, 1e7, 12345678.9, 1e15, 1e16, 1e23, -2e-9, -0.3, 100.0]
    values += [rng.uniform(0, 1) * 10 ** rng.randint(-8, 20) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical.json_float(F.col("v")).alias("t"))
    assert [r for r in df.collect() if r["t"] != json.dumps(r["v"])] == []


def test_canonical_strings(spark):
    values = [s for s in NASTY if s is not None] + ["\b\f\r", "\x7f", "€" * 50000]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", canonical.json_string(F.col("v")).alias("t"))
    assert [r for r in df.collect() if r["t"] != json.dumps(r["v"])] == []
