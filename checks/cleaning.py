"""Projection, cleaning and rendering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import oracle, table, view
from gaugemill.functions import columns, text
from gaugemill.operators import runlog, splits

# RE2 class of the characters that count as whitespace.
_WS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def _clean(column: str) -> str:
    """Entities the stand-in texts hold, &amp; last, then whitespace."""
    decoded = f"coalesce({column}, '')"
    for entity, shown in (("&eacute;", "'é'"), ("&nbsp;", "chr(160)"), ("&#39;", "chr(39)"), ("&copy;", "'©'"),
                          ("&copy=1", "'©=1'"), ("&middot;", "'·'"), ("&quot;", "chr(34)"), ("&lt;", "'<'"),
                          ("&gt;", "'>'")):
        # a doubled ampersand entity must not decode twice
        decoded = f"replace({decoded}, '{entity}', {shown})"
    decoded = decoded.replace("coalesce(", "replace(coalesce(", 1).replace(", '')", ", ''), '&amp;', chr(1))", 1)
    decoded = f"replace({decoded}, chr(1), '&')"
    return f"trim(regexp_replace({decoded}, '{_WS}', ' ', 'g'), ' ')"


_DATE = "strptime(date, '%d-%b-%y')"
_BUCKET = ("case when rating >= 0 and rating <= 4 then 'low' when rating > 4 and rating <= 7 then 'medium' "
           "when rating > 7 and rating <= 10 then 'high' end")
_WORDS = "case when t = '' then 0 else len(string_split(t, ' ')) end"


def clean_text(spark, sf):
    return view(spark, sf, "reviews_raw").select("uniqueID", text.clean_text(F.col("review")).alias("clean"))


def clean_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


def parse_date(spark, sf):
    return view(spark, sf, "reviews_raw").select("uniqueID", columns.parse_date(F.col("date")).alias("review_date"))


def extract_year(spark, sf):
    return view(spark, sf, "reviews_raw").select(
        "uniqueID", F.year(columns.parse_date(F.col("date"))).alias("review_year")
    )


def text_length(spark, sf):
    clean = view(spark, sf, "reviews_raw").select("uniqueID", text.clean_text(F.col("review")).alias("t"))
    return clean.select("uniqueID", F.length("t").alias("review_length"))


def word_count(spark, sf):
    clean = view(spark, sf, "reviews_raw").select("uniqueID", text.clean_text(F.col("review")).alias("t"))
    return clean.select("uniqueID", text.word_count(F.col("t")).alias("words"))


def rating_bucket(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("rating", F.col("l_quantity") / 4 - 1)
    return rows.groupBy(columns.rating_bucket(F.col("rating")).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("rating").alias("low"), F.max("rating").alias("high")
    )


def cast_columns(spark, sf):
    rows = view(spark, sf, "reviews_raw")
    return rows.select(
        columns.required(F.col("uniqueID"), "int", "uniqueID").alias("unique_id"),
        columns.required(F.col("rating"), "smallint", "rating").alias("rating"),
        columns.required(F.col("usefulCount"), "int", "usefulCount").alias("useful_count"),
    )


def rename_select(spark, sf):
    raw = view(spark, sf, "reviews_raw")
    return splits.prepare_split(raw.where("split = 'reference'"), "reference")


def split_literal(spark, sf):
    return view(spark, sf, "reviews_raw").select("uniqueID", F.lit("current").alias("split"))


def sentiment_filter(spark, sf):
    return splits.sentiment_rows(view(spark, sf, "reviews_raw")).select("uniqueID", "rating", "sentiment")


def build_xy(spark, sf):
    rows = view(spark, sf, "reviews_raw").withColumnsRenamed({"uniqueID": "unique_id", "review": "review_text"})
    return splits.text_and_label(splits.sentiment_rows(rows))


def perturb_text(spark, sf):
    doc = table(spark, sf, "documents")
    return doc.select(
        "doc_id", *[text.perturb(F.col("text"), how).alias(how) for how in ("whitespace", "trailing_period", "lowercase")]
    )


def perturb_char_swap(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.perturb(F.col("text"), "char_swap", F.col("doc_id")).alias("swapped")
    )


def negation_prefix(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", text.negation_prefix(F.col("text"), F.col("turn")).alias("negated"))


def format_prediction(spark, sf):
    doc = table(spark, sf, "documents")
    return doc.select(
        "doc_id",
        text.format_prediction(
            F.col("text"), (F.col("doc_id") % 2), (F.col("n_chars") % 1000) / F.lit(1000.0) + 0.00015,
            F.concat(F.lit("run-"), "source"), F.concat(F.lit("v-"), "lang"),
        ).alias("line"),
    )


def event_render(spark, sf):
    return runlog.render(view(spark, sf, "run_events"))


QUERIES = {
    f.__name__: f
    for f in (clean_text, clean_pages, parse_date, extract_year, text_length, word_count, rating_bucket, cast_columns,
              rename_select, split_literal, sentiment_filter, build_xy, perturb_text, perturb_char_swap,
              negation_prefix, format_prediction, event_render)
}

_PREPARED = f"""
SELECT cast(uniqueID AS int) AS unique_id, drugName AS drug_name, condition, t AS review_text,
       cast(rating AS smallint) AS rating, {_BUCKET} AS rating_bucket, {_DATE} AS review_date,
       cast(year({_DATE}) AS smallint) AS review_year, usefulCount AS useful_count,
       cast(length(t) AS int) AS review_length, cast({_WORDS} AS int) AS review_word_count, split
FROM (SELECT *, {_clean('review')} AS t FROM reviews_raw)"""

ORACLES = {
    "clean_text": oracle(f"SELECT uniqueID, {_clean('review')} AS clean FROM reviews_raw", "reviews_raw"),
    "clean_pages": f"SELECT page_id, {_clean('html')} AS clean FROM pages",
    "parse_date": oracle(f"SELECT uniqueID, {_DATE} AS review_date FROM reviews_raw", "reviews_raw"),
    "extract_year": oracle(f"SELECT uniqueID, cast(year({_DATE}) AS int) AS review_year FROM reviews_raw", "reviews_raw"),
    "text_length": oracle(
        f"SELECT uniqueID, cast(length({_clean('review')}) AS int) AS review_length FROM reviews_raw", "reviews_raw"),
    "word_count": oracle(
        f"SELECT uniqueID, cast({_WORDS} AS int) AS words FROM (SELECT uniqueID, {_clean('review')} AS t FROM reviews_raw)",
        "reviews_raw"),
    "rating_bucket": f"SELECT {_BUCKET} AS bucket, count(*) AS n, min(rating) AS low, max(rating) AS high "
                     "FROM (SELECT l_quantity / 4 - 1 AS rating FROM lineitem) GROUP BY 1",
    "cast_columns": oracle(
        "SELECT cast(uniqueID AS int) AS unique_id, cast(rating AS smallint) AS rating, usefulCount AS useful_count FROM reviews_raw",
        "reviews_raw"),
    "rename_select": oracle(_PREPARED + " WHERE split = 'reference'", "reviews_raw"),
    "split_literal": oracle("SELECT uniqueID, 'current' AS split FROM reviews_raw", "reviews_raw"),
    "sentiment_filter": oracle(
        "SELECT uniqueID, rating, cast(case when rating >= 7 then 1 else 0 end AS tinyint) AS sentiment "
        "FROM reviews_raw WHERE rating >= 7 OR rating <= 4", "reviews_raw"),
    "build_xy": oracle(
        "SELECT uniqueID AS unique_id, review AS review_text, cast(case when rating >= 7 then 1 else 0 end AS tinyint) AS sentiment "
        "FROM reviews_raw WHERE rating >= 7 OR rating <= 4", "reviews_raw"),
    "perturb_text": f"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ') AS whitespace, "
                    "rtrim(text, '.') || '.' AS trailing_period, lower(text) AS lowercase FROM documents",
    "negation_prefix": "SELECT conv_id, turn, case turn % 3 when 0 then 'I disagree, ' when 1 then 'Not really - ' "
                       "else 'On the contrary, ' end || text AS negated FROM conversations",
    "format_prediction": r"""
SELECT doc_id, 'label=' || (doc_id % 2) || case when doc_id % 2 = 1 then ' (positive)' else ' (negative)' end
  || ' prob=' || printf('%.4f', (n_chars % 1000) / 1000.0::double + 0.00015::double)
  || ' champion=run-' || source || ' version=v-' || lang || ' | '
  || case when contains(text, chr(39)) and not contains(text, chr(34)) then chr(34) || e || chr(34)
          else chr(39) || replace(e, chr(39), '\' || chr(39)) || chr(39) end AS line
FROM (SELECT *, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS e FROM documents)""",
    "event_render": oracle("""
SELECT seq, line FROM (SELECT seq, case type
  when 'FlowStateChanged' then 'flow ' || from_state || ' → ' || to_state
  when 'StepStateChanged' then '  step ' || step_name || ' ' || from_state || ' → ' || to_state
  when 'ContainerStarted' then '    container ' || left(container_id, 12) || ' started on ' || host_id || ' (' || step_name || ')'
  when 'ContainerExited' then '    container ' || left(container_id, 12) || ' exited code=' || exit_code || ' (' || step_name || ')'
  when 'LogChunk' then case when rtrim(data) <> '' then '      ' || step_name || '| ' || rtrim(data) end end AS line
  FROM run_events) WHERE line IS NOT NULL""", "run_events"),
}
