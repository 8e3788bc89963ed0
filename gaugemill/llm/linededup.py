"""Lines that many documents share are kept once (main path: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import BLANKS, ID, ROW, ascii_lower, with_row_keys
from gaugemill.session import stage

_AT, _LINE, _LOST = "__gm_at", "__gm_line", "__gm_lost"


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2,
    lines_as: str = "n_lines", dropped_as: str = "n_dropped",
) -> DataFrame:
    """``docs`` with every line removed whose key at least ``min_docs`` documents hold, except in the smallest id.

    A text is cut at \\n (null or empty: one empty line). A line's key is the line without blanks at both ends, A-Z
    lower-cased; keys shorter than ``min_chars`` code points are left alone. Columns ``lines_as`` (lines before) and
    ``dropped_as`` are added, or replaced if present; a null text becomes an empty one. All rows of one id are one
    document, null ids being one too, with the largest id. No rows in, no rows out.

    Keys travel as hashes: a partial aggregate leaves one row per key and task, so a line in a third of all documents
    is no hot spot. Only positions of lost lines go back to the documents; texts are shuffled once.
    """
    rows = with_row_keys(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ascii_lower(F.btrim(F.col(_LINE), F.lit(BLANKS)))
    lines = (
        rows.select(ID, ROW, F.posexplode(F.split(text, "\n", -1)).alias(_AT, _LINE))
        .where(F.char_length(F.btrim(F.col(_LINE), F.lit(BLANKS))) >= min_chars)
        .select(ID, ROW, _AT, F.xxhash64(key).alias("k1"), F.xxhash64(F.lit("line"), key).alias("k2"))
    )
    if min_docs == 2:
        shared = lines.groupBy("k1", "k2").agg(F.min(ID).alias("first"), F.max(ID).alias("last")).where("first < last")
    else:
        shared = (
            lines.select("k1", "k2", ID).distinct().groupBy("k1", "k2")
            .agg(F.min(ID).alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
        )
    shared = stage(shared.select("k1", "k2", "first"), "shared-lines")  # so that the join below can split hot keys
    lost = (
        lines.join(shared, ["k1", "k2"]).where(F.col(ID) > F.col("first"))
        .groupBy(F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in")).agg(F.collect_set(_AT).alias(_LOST))
    )
    whole = F.col(_LINE)
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(_LOST))  # linear, unlike a search per line
    return (
        rows.join(lost, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")), "left")
        .withColumn(_LINE, F.split(text, "\n", -1))
        .withColumns({
            lines_as: F.size(whole).cast("long"),
            dropped_as: F.when(F.col(_LOST).isNull(), 0).otherwise(F.size(_LOST)).cast("long"),
            text_col: F.when(F.col(_LOST).isNull(), text)
            .otherwise(F.array_join(F.transform(left, lambda at: F.get(whole, at)), "\n")),
        })
        .drop(ID, ROW, "__gm_of", "__gm_in", _LINE, _LOST)
    )
