"""Words of a corpus, their neighbours at one edit, and the form each is a variant of, from a dictionary of trie-node pairs."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import SLICE_BYTES, slices
from gaugemill.session import discard, stage

#: Different words that a task counts before it passes their counts on.
MOST_HELD = 200_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, deletes: int | None = 31) -> DataFrame:
    """``word`` and how often it occurs, ``n``, over all texts: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.

    With ``deletes``, a run whose crc32 of ``<id>:<run>`` it divides loses its letter at crc32 % length. Only words of
    ``least`` letters or more count. Null and empty texts have no words; a null id is an empty text in ``<id>``. Repeated rows
    count each time.
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall  # from where a run begins, so runs are maximal
    limit, held, kind = SLICE_BYTES, MOST_HELD, pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                for key, text in zip(part.column("__gm_key").to_pylist(), part.column(text_col).to_pylist(), strict=True):
                    found = find(text.encode().lower().decode()) if text else ()
                    if not deletes:
                        counts.update(found)
                        continue
                    start = zlib.crc32(f"{key or ''}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % deletes == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        counts[word] += n
                if len(counts) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=kind)
                    counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema=kind)

    given = docs.select(F.col(id_col).cast("string").alias("__gm_key"), text_col)
    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _nodes(strings: DataFrame, name: str, as_: str) -> DataFrame:
    """A number for each string that is found more than once: the nodes of a trie below which lie several words.

    Numbers are dealt as the table is written, and read from it ever after.
    """
    several = strings.groupBy(name).agg(F.count("*").alias("k")).where("k > 1").select(name)
    return stage(several.withColumn(as_, F.monotonically_increasing_id()), f"spelling-{as_}")


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of ``w`` of all words (``w``, ``word``, all different) that differ by one inserted, deleted or replaced letter.

    Both directions are returned, each pair once. A word cut at a place is a pair of nodes: its prefix in the trie of words
    and its suffix in the trie of reversed words. With a letter left out at the cut, the pair stands for the word without it.
    Two words that meet in a pair are neighbours: both without a letter (replaced), or one of them whole (inserted). A pair
    of nodes gathers one whole word and as many others as there are letters at most, 91 in all, so pairing its words is
    bounded. Nodes with a single word below them meet nobody and are left out.
    """
    letters = F.sequence(F.lit(0), F.length("word"))
    cuts = stage(
        words.select("w", "word", F.explode(letters).alias("i"))
        .select("w", "i", F.length("word").alias("l"), F.expr("substring(word, 1, i)").alias("prefix"),
                F.expr("substring(word, i + 1)").alias("suffix")), "spelling-cuts")
    forward = _nodes(cuts, "prefix", "p")
    backward = _nodes(cuts, "suffix", "s")
    fronts = cuts.join(forward, "prefix").select("w", "i", "p")
    backs = cuts.join(backward, "suffix").select("w", "i", "s")
    whole = fronts.join(backs, ["w", "i"]).select("w", "p", "s")
    without = fronts.join(backs.select("w", (F.col("i") - 1).alias("i"), "s"), ["w", "i"]).select("w", "p", "s")
    dictionary = stage(whole.unionByName(without), "spelling-dictionary")
    discard(cuts, forward, backward)
    met = dictionary.groupBy("p", "s").agg(F.collect_list("w").alias("ws")).where("size(ws) > 1")  # 91 at most, as above
    return (
        met.select(F.explode("ws").alias("a"), "ws").select("a", F.explode("ws").alias("b")).where("a <> b").distinct()
    )


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, ratio: int = 10,
    deletes: int | None = 31,
) -> DataFrame:
    """Every word of at least ``least`` letters and ``occurrences`` occurrences with the form it is a spelling variant of.

    Returns ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``. Words are near if one edit apart. The form is the
    near word of largest n, ties broken by code points, if that is at least ``ratio`` times the word's own; else null. The
    root follows forms to the last, the word itself if it has none: n grows at each step, so there are no cycles, and steps
    are doubled each round. An empty table has no words. See ``count_words`` for nulls and repeated rows.
    """
    counted = count_words(docs, id_col, text_col, least, deletes).where(F.col("n") >= occurrences)
    words = stage(counted.withColumn("w", F.monotonically_increasing_id()), "spelling-words")
    near = stage(neighbours(words.select("w", "word")), "spelling-near")
    best = (
        near.join(words.select(F.col("w").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n")), "b")
        .groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "b")).alias("best"))
        .select(F.col("a").alias("w"), "n_near", F.col("best.form").alias("form"), F.col("best.b").alias("f"), (-F.col("best.less")).alias("form_n"))
    )
    fits = F.col("form_n") >= ratio * F.col("n")
    formed = stage(
        words.join(best, "w", "left").select(
            "w", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            *(F.when(fits, F.col(c)).alias(c) for c in ("form", "f", "form_n"))), "spelling-formed")
    discard(near)
    roots = stage(formed.where("f is not null").select("w", F.col("f").alias("r")), "spelling-roots")
    while True:
        further = roots.select(F.col("w").alias("r"), F.col("r").alias("next"))
        if roots.join(further, "r", "left_semi").isEmpty():
            break
        before, roots = roots, stage(
            roots.join(further, "r", "left").select("w", F.coalesce("next", "r").alias("r")), "spelling-roots")
        discard(before)
    named = roots.join(words.select(F.col("w").alias("r"), F.col("word").alias("root")), "r").select("w", "root")
    return formed.join(named, "w", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
