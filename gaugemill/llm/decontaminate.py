"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, and a check on shingles
(main path: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import BLANKS, ID, ROW, ascii_lower, with_row_keys
from gaugemill.session import stage

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 75
#: Bits in which fingerprints may differ. Four blocks of 16 bits then hold one that differs in RADIUS // 4 at most.
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
#: Shingles of items that are broadcast at once; a larger benchmark is searched for in several blocks of items.
BLOCK_SHINGLES = 400_000
#: Windows up to which documents are picked by a broadcast list; beyond, by a shuffled join.
PICKED_BY_BROADCAST = 300_000


def _words(text: Column) -> Column:
    """A-Z lower-cased words; an empty array for a null or blank text."""
    trimmed = F.btrim(ascii_lower(text), F.lit(BLANKS))
    return F.when(F.char_length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _gram_hashes(hashes: Column, size: int) -> Column:
    """Hashes of ``size`` consecutive words, by the place of the first, from the words' hashes."""
    return F.when(
        F.size(hashes) >= size,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _grams(words: Column) -> Column:
    """The shingles themselves; fewer words than a shingle are one."""
    size = F.least(F.size(words), F.lit(SHINGLE))
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))


def _fingerprint(words: Column) -> Column:
    """SimHash of 64 bits: each bit as most words' hashes have it, a repeated word counting each time."""
    hashes = F.transform(words, lambda w: F.xxhash64(F.lit("simhash"), w))
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + _bit(h, b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda found, b: found.bitwiseOR(F.when(ones(b) * 2 > F.size(words), _shifted(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _bit(h: Column, b: Column) -> Column:
    return F.call_function("getbit", h, b).cast("int")


def _shifted(x: Column, b: Column) -> Column:
    return F.call_function("shiftleft", x, b)


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Each item's words, their number ``l``, its shingles and its fingerprint; items without words are left out."""
    items = benchmark.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return items.withColumns({"l": F.size("words"), "grams": _grams(F.col("words")), "print": _fingerprint(F.col("words"))})


def _anchors(rows: DataFrame, text_col: str, items: DataFrame) -> DataFrame:
    """Places of the documents' shingles that some item has, with the number of words ``l`` of such items and ``d`` of the text.

    A window that is similar to an item shares most of its shingles, so windows without any need no fingerprint.
    """
    hashed = items.select(
        "l", F.least("l", F.lit(SHINGLE)).alias("size"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    sizes = [r[0] for r in hashed.select("size").distinct().collect()]  # 1 to SHINGLE
    words = rows.select(ID, ROW, F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("wh")).withColumn("d", F.size("wh"))
    found = []
    for size in sorted(sizes):
        wanted = hashed.where(F.col("size") == size).select("l", F.explode(_gram_hashes(F.col("wh"), size)).alias("gram"))
        wanted = stage(wanted.distinct(), "leak-grams")
        blocks = max(1, -(-wanted.count() // BLOCK_SHINGLES))
        places = words.select(ID, ROW, "d", F.posexplode(_gram_hashes(F.col("wh"), size)).alias("at", "gram"))
        for block in range(blocks):
            part = wanted.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block)
            found.append(places.join(F.broadcast(part), "gram").select(ID, ROW, "d", "l", "at"))
    out = found[0] if found else rows.select(ID, ROW, F.lit(0).alias("d"), F.lit(0).alias("l"), F.lit(0).alias("at")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _dense_windows(anchors: DataFrame) -> DataFrame:
    """Starts of windows of ``l`` words with as many anchors as a similar item demands: a window's n shingles and an
    item's n have 6 n / 7 in common at 75 percent. A text of fewer words, with m shingles, is one window and has
    3 (n + m) / 7 in common. Linear in the anchors of a document."""
    shingles = F.col("l") - F.least("l", F.lit(SHINGLE)) + 1
    held = F.least("l", "d")
    places = (
        anchors.groupBy(ID, ROW, "d", "l").agg(F.array_sort(F.collect_set("at")).alias("p"))
        .withColumn("n", shingles)
        .withColumn("m", held - F.least(held, F.lit(SHINGLE)) + 1)
        .withColumn("t", F.ceil(F.lit(PERCENT) * (F.col("n") + F.col("m")) / F.lit(100 + PERCENT)).cast("int"))
        .where(F.size("p") >= F.col("t"))
    )
    whole = F.col("d") < F.col("l")
    each = places.select(ID, ROW, "d", "l", "n", "t", "p", F.explode(F.sequence(F.lit(0), F.when(whole, 0).otherwise(F.size("p") - F.col("t")))).alias("k"))
    low = F.when(whole, 0).otherwise(F.greatest(F.coalesce(F.get("p", F.col("k") - 1) + 1, F.lit(0)), F.get("p", F.col("k") + F.col("t") - 1) - F.col("n") + 1, F.lit(0)))
    return (
        each.select(ID, ROW, "l", low.alias("low"), F.when(whole, 0).otherwise(F.get("p", F.col("k"))).alias("high")).where("low <= high")
        .select(ID, ROW, "l", F.explode(F.sequence("low", "high")).alias("start"))
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``id_col``, ``item_col``, ``start`` (word, from 0) and
    ``n_words`` of the best window (the first of equals), and its ``similarity``.

    A window has as many words as the item; a text of fewer words is one window as a whole. Windows whose shingles are mostly an item's get a SimHash of their words;
    those within RADIUS bits of an item's meet it in one of four blocks, whose near values the item enters in advance;
    such pairs are checked on their five-word shingles, weighted by how often they occur: the common weight over the united.
    Words are A-Z lower-cased. Null and empty texts and items leak nothing. Repeated
    rows with one id give one row; a null id stays null. Only the benchmark, in blocks of bounded size, is broadcast.
    """
    rows = with_row_keys(docs.select(F.col(id_col).alias(id_col), text_col), id_col, text_col)
    items = stage(items_of(benchmark, item_col, item_text_col), "leak-items")
    windows = stage(_dense_windows(_anchors(rows, text_col, items)), "leak-windows")
    wanted = windows.groupBy(F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in")).agg(F.collect_list(F.struct("l", "start")).alias("w"))
    if windows.count() <= PICKED_BY_BROADCAST:
        wanted = F.broadcast(wanted)
    held = rows.join(wanted, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")))
    cut = (
        held.select(id_col, _words(F.col(text_col)).alias("words"), "w")
        .select(id_col, "words", F.explode("w").alias("w"))
        .where(F.col("w.start") + F.least(F.col("w.l"), F.size("words")) <= F.size("words"))
        .select(id_col, F.col("w.l").alias("l"), F.col("w.start").alias("start"), F.slice("words", F.col("w.start") + 1, F.col("w.l")).alias("words"))
    )
    printed = stage(cut.withColumn("print", _fingerprint(F.col("words"))), "leak-prints")
    entries = printed.select(id_col, "l", "start", "words", "print", F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)])).alias("e"))
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda m: F.bit_count(m) <= RADIUS // BLOCKS)
    probes = (
        items.select(F.col("item"), F.col("l"), F.col("print").alias("item_print"), F.explode(F.array(*[
            F.struct(F.lit(k).alias("block"), _block(F.col("print"), k).alias("value")) for k in range(BLOCKS)])).alias("e"))
        .select("item", "l", "item_print", "e.block", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("e.value")))).alias("value"))
    )
    met = (
        entries.select(id_col, "l", "start", "words", "print", "e.block", "e.value").join(probes, ["l", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select(id_col, "l", "start", "words", "item").distinct()
    )
    compared = met.withColumn("grams", _grams(F.col("words"))).join(items.select("item", "l", F.col("grams").alias("item_grams")), ["item", "l"])
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    common = F.aggregate(
        F.array_distinct("item_grams"), F.lit(0),
        lambda s, g: s + F.least(count(F.col("item_grams"), g), count(F.col("grams"), g)))
    total = F.size("item_grams") + F.size("grams")
    return (
        compared.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (total - F.col("common")))
        .select(id_col, "item", "start", F.size("words").alias("l"), (F.col("common") / (total - F.col("common"))).alias("similarity"))
        .groupBy(id_col, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "l")).alias("best"))
        .select(id_col, F.col("item").alias(item_col), (-F.col("best.back")).cast("long").alias("start"),
                F.col("best.l").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; of one id all rows go or none. Columns stay as they are."""
    leaked = stage(find_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias("__gm_of")).distinct(), "leaked")
    return docs.join(leaked, F.col(id_col).eqNullSafe(F.col("__gm_of")), "left_anti")
