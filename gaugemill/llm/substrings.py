"""Passages of words that an earlier document holds are cut, found by Rabin-Karp hashes that Spark counts."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm import windows as W
from gaugemill.llm.common import ID, ROW, map_texts, text_bytes, utf8, with_row_keys
from gaugemill.session import stage

#: Words of the part by which windows are gathered; only speed depends on it.
PART_WORDS = 10
_RUN = f"{ID} bigint, {ROW} bigint, part bigint, whole bigint, first int, n int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def gathered_runs(rows: DataFrame, text_col: str, window: int, part: int, of_bytes: bool) -> DataFrame:
    """Every run of windows of every text; see ``windows``. Items are bytes or words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(text_col)
        if of_bytes:
            data, texts = text_bytes(column)
            values = W.BYTE_VALUES[data]
        else:
            values, texts = W.words_of(column)
        found = W.runs(values, texts, window, min(part, window))
        at = pa.array(found["text"])
        return pa.RecordBatch.from_arrays([
            batch.column(ID).take(at), batch.column(ROW).take(at), _signed(found["part"].astype(np.uint64)),
            _signed(found["whole"].astype(np.uint64)), pa.array(found["first"], pa.int32()), pa.array(found["n"], pa.int32()),
        ], names=[ID, ROW, "part", "whole", "first", "n"])

    return map_texts(rows, text_col, [ID, ROW], _RUN, step)


def _windows(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """A row for each window of the runs in the column ``at`` (first * 2**32 + n, and the part's hash in ``parts``)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, texts = W.words_of(batch.column(text_col))
        sums = W.Prefixes(values)
        runs, parts = batch.column("at"), batch.column("parts")
        row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
        packed = runs.flatten().to_numpy()
        first, n = packed >> 32, packed & 0xFFFFFFFF
        each = np.repeat(np.arange(len(n)), n)
        at = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        start = at + texts[row[each]]
        of = pa.array(row[each])
        return pa.RecordBatch.from_arrays([
            batch.column(ID).take(of), batch.column(ROW).take(of), parts.flatten().take(pa.array(each)),
            _signed(sums.of(start, start + window)), pa.array(at, pa.int32()),
        ], names=[ID, ROW, "part", "whole", "at"])

    return map_texts(rows, text_col, [ID, ROW, "at", "parts"], f"{ID} bigint, {ROW} bigint, part bigint, whole bigint, at int", step)


def repeated_passages(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """Stretches of words, per row key, covered by windows that also start in a document of a smaller id.

    Runs are counted by the hash of their part. Where two documents share one, runs are compared whole: a run whose
    words an earlier document holds goes as one stretch. What is left, runs at the edges of passages, is compared
    window by window. Hashes are 64 bits for the part and 64 for the whole. Every count is a minimum of ids, which map
    tasks fold first, and what is joined back has been written before, so Spark can split the rows of a frequent key.
    """
    runs = stage(gathered_runs(rows, text_col, window, PART_WORDS, False), "passage-runs")
    parts = stage(
        runs.groupBy("part").agg(F.min(ID).alias("lo"), F.max(ID).alias("hi"), (F.min("whole") != F.max("whole")).alias("mixed"))
        .where("lo < hi").select("part", "mixed"), "passage-parts")
    shared = stage(runs.join(parts, "part"), "passage-shared")
    earliest = stage(shared.groupBy("part", "whole").agg(F.min(ID).alias("lo")), "passage-earliest")
    known = stage(shared.join(earliest, ["part", "whole"]), "passage-known")
    later = known.where(F.col(ID) > F.col("lo")).select(ID, ROW, "first", (F.col("n") + window - 1).alias("length"))
    edges = (
        known.where((F.col(ID) == F.col("lo")) & F.col("mixed"))
        .groupBy(F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in"))
        .agg(F.collect_list(F.struct(F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("at"), "part")).alias("runs"))
        .select("__gm_of", "__gm_in", F.col("runs.at").alias("at"), F.col("runs.part").alias("parts"))
    )
    edged = rows.select(ID, ROW, text_col).join(edges, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")))
    single = stage(_windows(edged, text_col, window), "passage-windows")
    first_seen = stage(
        single.groupBy("part", "whole").agg(F.min(ID).alias("lo"), F.max(ID).alias("hi")).where("lo < hi").select("part", "whole", "lo"),
        "passage-firsts")
    apart = (
        single.join(first_seen, ["part", "whole"]).where(F.col(ID) > F.col("lo"))
        .select(ID, ROW, F.col("at").alias("first"), F.lit(window).alias("length"))
    )
    return later.unionByName(apart)


def with_stretches(rows: DataFrame, stretches: DataFrame, as_: str) -> DataFrame:
    """``rows`` with all their stretches as an array of start * 2**32 + length, null where there are none."""
    packed = (
        stretches.groupBy(F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in"))
        .agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))).alias(as_))
    )
    return rows.join(packed, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")), "left").drop("__gm_of", "__gm_in")


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` without the passages of ``window`` words or more that a document of a smaller id holds.

    Adds ``n_words`` and ``n_removed`` and replaces ``text_col`` by the kept words, joined by one space; columns of those
    names are replaced. ``removed`` lists the cut intervals of words, maximal and in order. Windows are judged on the
    input, each by all rows. Null and empty texts, and texts of fewer words than a window, lose nothing. Rows of one
    id, null ids being one, never cut each other; equal rows are cut alike.
    """
    rows = with_row_keys(docs.drop("n_words", "n_removed", "removed"), id_col, text_col)
    cut = with_stretches(rows, repeated_passages(rows, text_col, window), "__gm_cut")
    keep = [c for c in cut.columns if c not in (text_col, "__gm_cut", ID, ROW)]
    fields = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [
        f"`{text_col}` string", "n_words bigint", "n_removed bigint", "removed array<struct<start: int, end: int>>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, losses, gaps = [], [], [], []
        for text, cuts in zip(utf8(batch.column(text_col)), batch.column("__gm_cut"), strict=True):
            words, removed = text.split(), []
            if cuts.is_valid:
                lost = W.covered(len(words), cuts.values.to_numpy())
                removed = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in W.spans(lost)), strict=True)]
                kept = list(compress(words, (~lost).tolist()))
            else:
                kept = words
            texts.append(b" ".join(kept).decode())
            sizes.append(len(words))
            losses.append(len(words) - len(kept))
            gaps.append(removed)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()),
             pa.array(losses, pa.int64()), pa.array(gaps, kind)],
            names=[*keep, text_col, "n_words", "n_removed", "removed"])

    return map_texts(cut, text_col, [*keep, "__gm_cut"], schema, step)
