"""Texts that share three quarters of their five-word shingles, and the groups such links form."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm import windows as W
from gaugemill.llm.common import ID, ROW, SLICE_BYTES, give_back, map_texts, slices, with_row_keys
from gaugemill.llm.groups import joined
from gaugemill.session import discard, reclaim, stage

#: Largest set size that may be joined by subsets; the boundary is chosen by cost up to here.
MOST_SMALL = 12
#: One text in so many is looked at for frequent shingles, of which at most HOT come last in the order of shingles.
#: This order decides about speed only: any order gives the same links.
SAMPLED, SEEN, HOT = 16, 2, 1 << 18
#: Ratio of set sizes in one part of a list, where lists are cut by size and place. An entry stands in two or three parts.
SIZE_STEP = 4 / 3
#: Shares of the lists that are made, and joined, one after the other: peak disk, not the result, depends on it.
BLOCKS = 4
#: List entries, before they are cut, for which one share is enough.
ONE_BLOCK = 1 << 20
#: Words of 64 bits in the short sketch of a set; each bit is the parity of the shingles that fall on it.
SKETCH = 4
_SKETCHED = [f"s{k}" for k in range(SKETCH)]
#: Rows up to which the texts to compare are picked by a broadcast list of their keys; beyond, by a shuffled join.
PICKED_BY_BROADCAST = 500_000


def needed(a: int, b: int, percent: int) -> int:
    """Least common shingles of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles, from the first in order, of which a set shares one with every set it is linked with."""
    return n - -(-percent * n // 100) + 1


def subset_keys(n: int, percent: int, most: int) -> list[tuple[int, int, int]]:
    """For a set of ``n``: the size pairs (smaller, larger) it may be linked in, and the subset size that proves it."""
    pairs = []
    for m in range(1, most + 1):
        low, high = sorted((n, m))
        if 100 * low >= percent * high:
            pairs.append((low, high, needed(low, high, percent)))
    return pairs


def subset_cost(n: int, percent: int, most: int) -> int:
    return sum(comb(n, c) for _, _, c in subset_keys(n, percent, most))


def _sets(batch: pa.RecordBatch, text_col: str, size: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles of each text in the common order, the text of each, set sizes, and a hash of each set."""
    values, texts = W.words_of(batch.column(text_col), lower=True)
    found, of = W.shingles(values, texts, size)
    found = (found >> np.uint64(2)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        found += (hot[at] == found).astype(np.int64) << 62
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[fresh], of[fresh]
    sizes = np.bincount(of, minlength=batch.num_rows)
    node = np.zeros(batch.num_rows, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        plain = (found & ((1 << 62) - 1)).astype(np.uint64)
        node[some] = W.mixed(np.add.reduceat(W.mixed(plain), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return found, of, sizes, node.view(np.int64)


def _frequent(rows: DataFrame, text_col: str, size: int) -> np.ndarray:
    """The most frequent shingles of a fixed share of all texts, at most HOT of them."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _sets(batch, text_col, size, np.zeros(0, np.int64))[0]
        return pa.RecordBatch.from_arrays([pa.array(found)], names=["shingle"])

    sample = rows.where(F.pmod(F.xxhash64(F.lit("sample"), text_col), F.lit(SAMPLED)) == 0)
    counted = map_texts(sample, text_col, [], "shingle bigint", step).groupBy("shingle").count().where(F.col("count") >= SEEN)
    top = counted.orderBy(F.desc("count"), "shingle").limit(HOT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64))


def _parities(found: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Sketches of the sets, one row of SKETCH words each. Two sets differ in at least as many shingles as their sketches in bits."""
    bits = 64 * SKETCH
    at = (W.mixed((found & ((1 << 62) - 1)).astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(of * bits + at, minlength=texts * bits) & 1).astype(np.uint8).reshape(texts, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def _long_parities(found: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sketches with two to four bits for each shingle, as lists of 64-bit words: a power of two of them, SKETCH at least.

    Half a sketch is folded out of the whole one by exclusive or.
    """
    words = np.where(sizes > 0, SKETCH << np.ceil(np.log2(np.maximum(2 * sizes / (64 * SKETCH), 1))).astype(np.int64), 0)
    ends = np.concatenate([[0], np.cumsum(words)])
    at = W.mixed((found & ((1 << 62) - 1)).astype(np.uint64)) & (64 * words[of] - 1).astype(np.uint64)
    at = at.astype(np.int64) + 64 * ends[of]
    ordered = np.sort(at)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    odd = ordered[first][np.diff(first, append=len(ordered)) % 2 == 1]
    filled = np.zeros(ends[-1], np.uint64)
    np.bitwise_or.at(filled, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(filled.view(np.int64)))


def _prefixes(rows: DataFrame, text_col: str, size: int, percent: int, hot: np.ndarray, most_small: int) -> DataFrame:
    """Per row: its set's hash, size, how many in a thousand of its shingles are not frequent, short sketch, prefix, long
    sketch, and the whole set if it is small. A task gives a set's shingles and long sketch once."""
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        seen: set[int] = set()  # of this task: no more than it has rows
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES):
                found, of, sizes, node = _sets(part, text_col, size, shared.value)
                first = np.cumsum(sizes) - sizes
                take = np.minimum(prefix_length(sizes, percent), sizes)
                new = []
                for n, key in zip(sizes.tolist(), node.tolist(), strict=True):
                    new.append(n > 0 and key not in seen)
                    seen.add(key)
                take = np.where(new, take, 0)
                sketch = _parities(found, of, part.num_rows)
                rare = 1000 * np.bincount(of, found < 1 << 62, part.num_rows).astype(np.int64) // np.maximum(sizes, 1)
                fresh = np.array(new, bool)[of]
                long = _long_parities(found[fresh], of[fresh], np.where(new, sizes, 0))
                whole = np.where(np.array(new, bool) & (sizes <= most_small), sizes, 0)
                yield pa.RecordBatch.from_arrays([
                    part.column(ID), part.column(ROW), pa.array(node), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()),
                    _lists(found, first, take), long, _lists(found, first, whole), *(pa.array(sketch[:, k]) for k in range(SKETCH)),
                ], names=[ID, ROW, "node", "n", "rare", "prefix", "long", "whole", *_SKETCHED])
        give_back()

    return rows.select(ID, ROW, text_col).mapInArrow(
        run, f"{ID} bigint, {ROW} bigint, node bigint, n int, rare int, prefix array<bigint>, long array<bigint>, whole array<bigint>, "
        + ", ".join(f"{c} bigint" for c in _SKETCHED))


def _lists(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at]))


def _subset_links(small: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Links among sets of at most ``boundary`` shingles: two that share a subset of the size that proves their link.

    Sets of one key are tied to its smallest set of the smaller size; with that one, all of them are linked.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for node, n, whole in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "whole")), strict=True):
                for low, high, size in subset_keys(n, percent, boundary):
                    chosen = np.array(list(combinations(sorted(whole), size)), np.int64).astype(np.uint64)
                    salt = np.uint64(low << 32 | high)
                    keys = W.mixed(np.add.reduce(W.mixed(chosen), axis=1) ^ W.mixed(np.array([salt]))).view(np.int64)
                    out.extend((k, low, n, node) for k in keys.tolist())
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
                 pa.array(columns[3], pa.int64())], names=["key", "low", "n", "node"])

    keyed = stage(small.select("node", "n", "whole").mapInArrow(run, "key bigint, low int, n int, node bigint"), "jaccard-subsets")
    centers = (
        keyed.groupBy("key", "low").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("node"))).alias("to"),
                                        (F.min("node") != F.max("node")).alias("several"))
        .where("several and to is not null").select("key", "low", "to"))
    links = stage(keyed.join(centers, ["key", "low"]).where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct(), "jaccard-links")
    discard(keyed)
    return links


def _cost_boundary(base: DataFrame, lists: DataFrame, percent: int) -> int:
    """The set size up to which enumerating subsets costs less than entering and scanning inverted lists.

    Costs are rows: a subset is one; a list entry is one, and one more for each set of a repeated list it stands in.
    Only sizes up to MOST_SMALL are counted, so what comes to the driver is that many rows.
    """
    sets = dict(base.where((F.size("prefix") > 0) & (F.col("n") <= MOST_SMALL)).groupBy("n").agg(F.count("*")).collect())
    scanned = dict(lists.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.sum("c")).collect())
    best, best_cost = 0, None
    for boundary in range(MOST_SMALL + 1):
        subsets = sum(k * subset_cost(n, percent, boundary) for n, k in sets.items() if n <= boundary)
        entered = sum(k * int(prefix_length(np.array(n), percent)) + scanned.get(n, 0) for n, k in sets.items()
                      if 100 * n >= percent * (boundary + 1))
        if best_cost is None or subsets + entered < best_cost:
            best, best_cost = boundary, subsets + entered
    return best


def _votes(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of sizes na and nb with the number ``v`` of prefix shingles they share, if that is enough for a link.

    Of the set whose prefix ends first all shared shingles up to there are counted; what follows is no more than its rest.
    The larger rest of the two is allowed for.
    """
    least = f"ceil({percent} * (na + nb) / {100 + percent}) - ceil({percent} * greatest(na, nb) / 100) + 1"
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("v")).where(F.expr(f"v >= {least}")).drop("na", "nb")


def _both_ends(pairs: DataFrame, of: DataFrame, few: bool) -> DataFrame:
    """``pairs`` a, b with the columns of ``of`` for either node, named after the column and the end. A node may have several equal rows.

    Each row of ``of`` goes to the pairs of its node, so it is made once; what is paired meets by one shuffle on the pair.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    at = of.join(F.broadcast(ends) if few else ends, "node")
    return at.groupBy("a", "b").agg(*(
        F.any_value(F.when(F.col("node") == F.col(x), F.col(c)), F.lit(True)).alias(f"{c}{x}") for c in of.columns if c != "node" for x in "ab"))


def _few(pairs: DataFrame) -> bool:
    return 2 * pairs.count() <= PICKED_BY_BROADCAST


def _verified(rows: DataFrame, base: DataFrame, pairs: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose sets have the similarity, counted on the whole sets."""
    few = _few(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = (
        base.where("n > 0").join(F.broadcast(named) if few else named, "node", "left_semi")
        .groupBy("node").agg(F.min(F.struct(ID, ROW)).alias("r")).select("node", F.col(f"r.{ID}").alias("__gm_of"), F.col(f"r.{ROW}").alias("__gm_in"))
    )
    picked = rows.select(ID, ROW, text_col).join(
        F.broadcast(wanted) if few else wanted, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, _, sizes, _ = _sets(batch, text_col, size, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([batch.column("node"), _lists(found, np.cumsum(sizes) - sizes, sizes)], names=["node", "s"])

    sets = map_texts(picked, text_col, ["node"], "node bigint, s array<bigint>", step)
    both = _both_ends(pairs.select("a", "b"), sets, few).select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    return stage(both.where(F.expr(f"100 * k >= {percent} * (na + nb - k)")).select("a", "b"), "jaccard-links")


def _repeated_entries(given: DataFrame) -> list[DataFrame]:
    """The entries of the sets' prefixes whose shingle has ``c`` > 1 of them, equal ones once, in one table or several."""
    entries = given.select("node", "n", "rare", F.posexplode("prefix").alias("at", "shingle"))
    blocks = BLOCKS if (given.agg(F.sum(F.size("prefix"))).first()[0] or 0) > ONE_BLOCK else 1
    parts = []
    for k in range(blocks):  # one share of the shingles after the other, so that their shuffles do not add up
        block = entries.where(F.pmod(F.xxhash64(F.lit("entries"), "shingle"), F.lit(blocks)) == k) if blocks > 1 else entries
        repeated = stage(block.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-repeated")
        reclaim(given.sparkSession)
        parts.append(stage(block.join(repeated, "shingle").distinct(), "jaccard-entries"))
        discard(repeated)
        del block, repeated
        reclaim(given.sparkSession)
    return parts


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries of the lists, each with the group ``comp`` of its set."""
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    if labels.count() <= PICKED_BY_BROADCAST:
        labels = F.broadcast(labels)
    return lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _to_hubs(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each set the set that leads most of its lists, if they may be linked: one pair per set at most.

    In the first turn a list is led by the set with the smallest share of shingles that are not frequent. In a large
    group of texts that were each changed in another place this is the one they were made from, which is linked with
    most of them, where two others may not be. In later turns it is led by the set with the smallest hash of the turn.
    Either way the lists of a group mostly have one leader.
    """
    lead = F.xxhash64(F.lit(turn), "node")
    if turn == 0:
        lead = F.shiftleft(F.col("rare").cast("long"), 40) + F.shiftrightunsigned(lead, 24)
    hubs = open_.groupBy("shingle").agg(*(F.min_by(c, lead).alias(x) for c, x in (("node", "b"), ("n", "nb"), ("comp", "cb"))))
    pairs = (
        open_.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), "comp").join(hubs, "shingle")
        .where(F.expr(f"comp <> cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)")).drop("shingle", "comp", "cb")
    )
    return stage(_votes(pairs, percent).groupBy("a").agg(F.max(F.struct("v", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "jaccard-pairs")


def _by_place(base: DataFrame, open_: DataFrame, percent: int, boundary: int) -> DataFrame:
    """All pairs of sets in different groups that stand in one list and fit in size and sketch.

    A pair's ``v`` is the larger the closer its sketches are, for the sizes of its sets. Lists are cut by size and place
    before anything is paired.

    Two linked sets share all they share from their first common shingle on, so at its places they have enough left: a set
    of n with the place p there links with none of more than (100 n - (100 + percent) p) / percent, its reach. One of the
    two then reaches its own size. Lists in which none does are dropped, the others are met by both sets' sizes and reaches.
    Texts that share a boilerplate too small to link them stand late in its lists and meet nowhere. Two that meet are a pair
    only if their sketches differ in no more bits than linked sets of their sizes may in shingles, which loses no link.
    """
    reached = open_.select("shingle", "node", "comp", "n", F.expr(f"cast((100L * n - {100 + percent}L * at) div {percent} as int)").alias("reach"))
    met = (
        reached.groupBy("shingle").agg((F.min("comp") != F.max("comp")).alias("several"), F.max(F.expr("reach >= n")).alias("reaches"))
        .where("several and reaches").select("shingle")
    )
    sketches = base.where(F.size("prefix") > 0).select("node", *_SKETCHED).dropDuplicates(["node"])
    places = stage(reached.join(met, "shingle").join(sketches, "node"), "jaccard-places")
    reclaim(base.sparkSession)
    step = lambda x: F.floor(F.log(x) / F.log(F.lit(SIZE_STEP))).cast("int")
    carried = ("node", "n", "reach", "comp", *_SKETCHED)
    differing = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _SKETCHED)
    parts = []
    blocks = BLOCKS if places.count() > ONE_BLOCK else 1
    for k in range(blocks):  # one share of the lists after the other, so that their shuffles do not add up
        block = places.where(F.pmod(F.xxhash64(F.lit("block"), "shingle"), F.lit(blocks)) == k).withColumns({
            "own": step(F.col("n")),
            "other": F.explode(F.sequence(step(F.ceil(F.lit(percent) * F.col("n") / 100)), step(F.greatest("reach", F.lit(1))))),
        })
        left = block.where("reach >= n").select("shingle", F.col("own").alias("x"), F.col("other").alias("y"), *(F.col(c).alias(f"{c}_a") for c in carried))
        right = block.select("shingle", F.col("other").alias("x"), F.col("own").alias("y"), *(F.col(c).alias(f"{c}_b") for c in carried))
        met = left.join(right, ["shingle", "x", "y"]).where(F.expr(
            f"node_a <> node_b and comp_a <> comp_b and (reach_b < n_b or node_a < node_b) and n_a <= reach_b and n_b <= reach_a "
            f"and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and greatest(n_a, n_b) > {boundary} "
            f"and {differing} <= n_a + n_b - 2 * ceil({percent} * (n_a + n_b) / {100 + percent})"))
        parts.append(stage(met.select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
            F.expr(f"cast(-1000 * ({differing}) div (n_a + n_b) as int)").alias("v")).distinct(), "jaccard-part"))
        del block, left, right, met
        reclaim(base.sparkSession)
    pairs = parts[0]
    if blocks > 1:
        pairs = stage(reduce(DataFrame.unionByName, parts).distinct(), "jaccard-met")
        discard(*parts)
    discard(places)
    reclaim(base.sparkSession)
    return pairs


def _able(pairs: DataFrame, base: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose long sketches differ in no more bits than linked sets of their sizes may in shingles."""
    ends = _both_ends(pairs.select("a", "b"), base.where(F.size("prefix") > 0).select("node", "n", F.col("long").alias("p")), _few(pairs))
    folded = lambda p, q: F.expr(
        f"if(size({p}) <= size({q}), {p}, aggregate(sequence(1, cast(size({p}) div size({q}) as int) - 1), slice({p}, 1, size({q})), "
        f"(whole, k) -> zip_with(whole, slice({p}, k * size({q}) + 1, size({q})), (u, v) -> u ^ v)))")
    ends = ends.withColumns({"fa": folded("pa", "pb"), "fb": folded("pb", "pa")})
    differing = "aggregate(zip_with(fa, fb, (u, v) -> bit_count(u ^ v)), 0, (x, y) -> x + y)"
    return stage(ends.where(F.expr(f"{differing} <= na + nb - 2 * ceil({percent} * (na + nb) / {100 + percent})")).select("a", "b"), "jaccard-able")


def _strongest(pairs: DataFrame) -> DataFrame:
    """For each set its closest one of ``pairs`` on either side: two pairs per set at most."""
    best = [pairs.groupBy(x).agg(F.max(F.struct("v", "a", "b")).alias("best")).select("best.a", "best.b") for x in "ab"]
    return best[0].unionByName(best[1]).distinct()


def _still_apart(pairs: DataFrame, tried: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` that were not tried and lie in different groups."""
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return pairs.where(apart).drop("ca", "cb").join(tried, ["a", "b"], "left_anti").select("a", "b", "v")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75,
    size_as: str = "n_shingles", group_as: str = "component_id",
) -> DataFrame:
    """``docs`` with the number of distinct shingles of each text and the smallest id that links lead to from it.

    Texts are A-Z lower-cased and cut into words; a text of fewer than ``shingle`` words is one shingle. Two texts link
    if ``percent`` of their united shingles are common. Null and empty texts have no shingles, link with nothing and
    keep their own id as group; so do texts without partners. Equal sets are one node, so copies are never paired. A null
    id counts as the largest. ``size_as`` and ``group_as`` replace columns of those names.

    Links are found by size. Sets up to a boundary, chosen by cost, enumerate the subsets that prove a link. Larger ones
    stand in inverted lists of their first shingles, in an order that puts frequent ones last. Lists are first
    joined with one leading set each, turn by turn, so that a group of near copies falls together without pairing its members;
    in the first turn the set with the fewest rare shingles leads, the likeliest origin of such a group.
    When turns bring few links, lists are cut by set size and place, and what is left is compared; while more pairs are left
    than there are sets, each set's closest pairs by sketch first. Pairs whose parity sketches differ too much, short ones in
    the lists and long ones before whole sets are built, are not compared. Links within a
    group that is known already change nothing and are not looked for. Similarities are counted on whole sets; shingles are hashes of 62 bits.
    """
    rows, grouped = _grouped(docs.drop(size_as, group_as), id_col, text_col, shingle, percent, size_as, group_as)
    return rows.join(grouped, F.expr(_OF_KEY), "left").drop("__gm_of", "__gm_in", ID, ROW, _GROUP)


#: The node that names a group inside; an id does not where rows of one id lie in several.
_GROUP = "__gm_comp"
#: A row and its key in a table of keys.
_OF_KEY = f"{ID} = __gm_of and {ROW} = __gm_in"


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, size_as: str, group_as: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the keys of their rows, and for each key its set's size, node group and smallest id."""
    rows = with_row_keys(docs, id_col, text_col)
    hot = _frequent(rows, text_col, shingle)
    base = stage(_prefixes(rows, text_col, shingle, percent, hot, MOST_SMALL), "jaccard-base")
    given = base.where(F.size("prefix") > 0)
    entered = _repeated_entries(given)
    lists = reduce(DataFrame.unionByName, entered)
    boundary = _cost_boundary(base, lists, percent)
    by_subsets = _subset_links(given.where(F.col("n") <= boundary), percent, boundary) if boundary else None
    long = lists.where(F.expr(f"100 * n >= {percent} * {boundary + 1}")).drop("c")

    def tell(pairs: DataFrame, labels: DataFrame | None, tried: int) -> tuple[DataFrame, bool]:
        """The groups once the links among ``pairs`` are known, and whether they are few of those tried."""
        links = _verified(rows, base, pairs, text_col, shingle, percent)
        few = 2 * links.count() <= tried
        if labels is None and by_subsets is not None:
            labels = joined(None, links.unionByName(by_subsets))
            discard(links, by_subsets)
            return labels, few
        return joined(labels, links), few

    turn, labels, few = 0, None, False
    while not few:
        pairs = _to_hubs(_labelled(long, labels), turn, percent)
        labels, few = tell(pairs, labels, pairs.count())
        turn += 1
        discard(pairs)
        reclaim(rows.sparkSession)
    rest = _by_place(base, _labelled(long, labels), percent, boundary)
    discard(*entered)
    few, sets = False, base.count()
    while not few and rest.count() > sets:  # the likeliest links first: within the groups they make, no other pair needs a look
        best, before = stage(_strongest(rest), "jaccard-pairs"), rest
        pairs = _able(best, base, percent)
        labels, few = tell(pairs, labels, best.count())
        rest = stage(_still_apart(rest, best, labels), "jaccard-apart")
        discard(best, pairs, before)
        reclaim(rows.sparkSession)
    if not rest.isEmpty():
        pairs = _able(rest, base, percent)
        labels, _ = tell(pairs, labels, 0)
        discard(pairs)
    discard(rest)
    reclaim(rows.sparkSession)
    members = stage(base.select(ID, ROW, "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-members")
    smallest = members.where("n > 0").groupBy("comp").agg(F.min(ID).alias(group_as))
    return rows, members.join(smallest, "comp", "left").select(
        F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in"), F.col("n").cast("long").alias(size_as), F.col("comp").alias(_GROUP),
        F.when(F.col("n") > 0, F.col(group_as)).otherwise(F.col(ID)).alias(group_as)).distinct()


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id; columns stay as they are.

    Of rows with this id one is kept, the one with the smallest text hash. Texts without words are in no group and stay.
    """
    size, group = "__gm_size", "__gm_group"
    rows, grouped = _grouped(docs, id_col, text_col, shingle, percent, size, group)
    chosen = grouped.where(f"{size} > 0 and __gm_of = {group}").groupBy(_GROUP).agg(F.min("__gm_of").alias("__gm_of"), F.min("__gm_in").alias("__gm_in"))
    keys = chosen.select("__gm_of", "__gm_in", F.lit(True).alias("__gm_once")).unionByName(
        grouped.where(f"{size} = 0").select("__gm_of", "__gm_in", F.lit(False).alias("__gm_once")))
    # the keys are chosen without the texts, which are dealt out once; rows without words are all kept
    copy = F.when(F.col("__gm_once"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    return (
        rows.join(keys, F.expr(_OF_KEY)).withColumn("__gm_copy", copy)
        .dropDuplicates([ID, ROW, "__gm_copy"]).select(*docs.columns)
    )
