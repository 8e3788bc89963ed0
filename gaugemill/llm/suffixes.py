"""Byte strings that occur anywhere else are cut, found by suffix arrays of bounded shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm import windows as W
from gaugemill.llm.common import ID, ROW, map_texts, utf8, with_row_keys
from gaugemill.llm.substrings import gathered_runs, with_stretches
from gaugemill.session import stage

#: Bytes of the part by which windows are gathered; only speed depends on it.
PART_BYTES = 40
#: Bytes a shard is meant to hold, and pieces of one part hash in a shard before they are dealt out over several.
SHARD_BYTES, SHARD_PIECES = 2 << 20, 4000
#: Symbols of 9 bits (a byte and one, or 0 behind each piece) in the first sorting key.
_KEY = 7


def _keys(symbols: np.ndarray) -> np.ndarray:
    """The first symbols of every suffix as one number each."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(_KEY, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(_KEY):
        key = key << 9 | padded[k:n + k]
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson and Sadakane: groups that are still tied are refined by the rank of what follows,
    which doubles the compared length each round; sorted suffixes are not touched again."""
    n, key = len(symbols), _keys(symbols)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)  # of its group's first place
    slots = np.arange(n)
    opens = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(opens, slots, 0))
    length = _KEY
    while True:
        tied = ~opens | ~np.concatenate([opens[1:], [True]])
        slots, opens = slots[tied], opens[tied]
        if not len(slots) or length >= n:
            return order
        group = order[slots]
        ahead = group + length
        follows = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[group]
        by = np.argsort(first * (n + 1) + follows, kind="stable")
        group, follows, first = group[by], follows[by], first[by]
        order[slots] = group
        opens = np.concatenate([[True], (follows[1:] != follows[:-1]) | (first[1:] != first[:-1])])
        rank[group] = np.maximum.accumulate(np.where(opens, slots, 0))
        length *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai's array: for each place in ``order`` the prefix shared with the place before it.

    In text order a value is at least its left neighbour's less one, and exactly that where the suffix before it moves
    along; only the other places are compared, all at once, a key at a time.
    """
    n, keys = len(symbols), _keys(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    moves = np.zeros(n, bool)
    moves[1:] = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (symbols[:-1] == symbols[before[:-1]])
    at = np.flatnonzero(~moves & (before >= 0))
    room = n - np.maximum(at, before[at])
    size, live = np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        apart = keys[at[live] + size[live]] ^ keys[before[at[live]] + size[live]]
        for k in range(_KEY):
            size[live] += apart >> 9 * k == 0
        live = live[(apart == 0) & (size[live] < room[live])]
    found = np.zeros(n, np.int64)
    found[at] = np.minimum(size, room)
    places = np.arange(n)
    base = np.maximum.accumulate(np.where(moves, 0, places))
    return np.where(moves, found[base] - (places - base), found)[order]


def _laid_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all pieces, a 0 behind each, with where pieces begin and how long they are."""
    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    pieces = pieces.cast(pa.large_binary())
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    begin = offsets[:-1] - offsets[0] + np.arange(len(sizes))
    symbols = np.zeros(len(data) + len(sizes), np.int16)
    mask = np.ones(len(symbols), bool)
    mask[begin + sizes] = False
    symbols[mask] = data.astype(np.int16) + 1
    return symbols, begin, sizes


def repeated_in_shard(pieces: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of ``pieces`` occur twice: over all window starts, with the piece of each and its offset there."""
    symbols, begin, sizes = _laid_out(pieces)
    order = suffix_array(symbols)
    long_ = common_prefixes(symbols, order) >= window
    twice = np.zeros(len(symbols), bool)
    twice[order[long_]] = True
    twice[order[:-1][long_[1:]]] = True
    counts = np.maximum(sizes - window + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    return twice[begin[piece] + offset], piece, offset


_FOUND = f"{ID} bigint, {ROW} bigint, first int, length int"


def _stretches(table: pa.Table, twice: np.ndarray, piece: np.ndarray, offset: np.ndarray, window: int) -> pa.Table:
    """Covered stretches of the documents that the pieces come from; those known as repeated are left to the caller."""
    once = table.column("n_same").to_numpy() == 1
    marked = twice & once[piece]
    edge = np.concatenate([[False], marked, [False]])
    joined = np.concatenate([[False], piece[1:] == piece[:-1], [False]]) if len(piece) else np.zeros(1, bool)
    opens = np.flatnonzero(edge[1:-1] & ~(edge[:-2] & joined[:-1])) if len(piece) else np.zeros(0, np.int64)
    closes = np.flatnonzero(edge[1:-1] & ~(edge[2:] & joined[1:])) if len(piece) else np.zeros(0, np.int64)
    of = pa.array(piece[opens])
    first = table.column("first").to_numpy()[piece[opens]] + offset[opens]
    return pa.table([
        table.column(ID).take(of), table.column(ROW).take(of), pa.array(first, pa.int32()),
        pa.array(closes - opens + window, pa.int32()),
    ], names=[ID, ROW, "first", "length"])


def _pieces(rows: DataFrame, text_col: str, samples: DataFrame, window: int) -> DataFrame:
    """The bytes of each distinct run to compare, cut out of its document."""
    wanted = (
        samples.groupBy(F.col(ID).alias("__gm_of"), F.col(ROW).alias("__gm_in"))
        .agg(F.collect_list(F.struct("part", "whole", "first", "n", "n_same")).alias("w"))
        .select("__gm_of", "__gm_in", *[F.col(f"w.{c}").alias(c) for c in ("part", "whole", "first", "n", "n_same")])
    )
    held = rows.select(ID, ROW, text_col).join(wanted, (F.col(ID) == F.col("__gm_of")) & (F.col(ROW) == F.col("__gm_in")))
    lists = ["part", "whole", "first", "n", "n_same"]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(text_col))
        columns = [batch.column(c) for c in lists]
        row = np.repeat(np.arange(batch.num_rows), np.diff(columns[0].offsets.to_numpy()))
        flat = {c: x.flatten() for c, x in zip(lists, columns, strict=True)}
        first, n = flat["first"].to_numpy(), flat["n"].to_numpy()
        cut = [texts[r][a:a + k + window - 1] for r, a, k in zip(row.tolist(), first.tolist(), n.tolist(), strict=True)]
        of = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(ID).take(of), batch.column(ROW).take(of), *(flat[c] for c in ("part", "whole", "first", "n_same")),
             pa.array(cut, pa.binary())],
            names=[ID, ROW, "part", "whole", "first", "n_same", "piece"])

    schema = f"{ID} bigint, {ROW} bigint, part bigint, whole bigint, first int, n_same bigint, piece binary"
    return map_texts(held, text_col, [ID, ROW, *lists], schema, step)


def _merged_shards(pieces: DataFrame, window: int) -> DataFrame:
    """Repeats among the pieces of parts that are dealt out over several shards (``of`` of them).

    Each shard sorts its windows' hashes and cuts them by binary search at the bounds of as many ranges as there are
    shards. A range merges its slices, each looked up in the others by binary search, and returns to each shard what
    another one holds. So neither a shard nor a range ever sees a whole part.
    """

    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        symbols, begin, sizes = _laid_out(table.column("piece"))
        every = W.Prefixes(W.BYTE_VALUES[np.maximum(symbols, 1) - 1]).every(window)
        counts = np.maximum(sizes - window + 1, 0)
        piece = np.repeat(np.arange(len(sizes)), counts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        return every[begin[piece] + offset], piece, offset

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        shards = table.column("of")[0].as_py()
        found = np.unique(hashes(table)[0])
        bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
        slices = np.split(found, np.searchsorted(found, bounds))
        return pa.table({"part": [key[0].as_py()] * shards, "shard": [key[1].as_py()] * shards, "range": list(range(shards)),
                         "hashes": pa.array([s.tobytes() for s in slices], pa.binary())},
                        schema=pa.schema([("part", pa.int64()), ("shard", pa.int32()), ("range", pa.int32()), ("hashes", pa.binary())]))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        slices = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        union = np.sort(np.concatenate(slices))
        shared = [s[np.searchsorted(union, s, "right") - np.searchsorted(union, s, "left") > 1] for s in slices]
        return pa.table({"part": table.column("part"), "shard": table.column("shard"),
                         "hashes": pa.array([s.tobytes() for s in shared], pa.binary())})

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({ID: pa.array([], pa.int64()), ROW: pa.array([], pa.int64()),
                             "first": pa.array([], pa.int32()), "length": pa.array([], pa.int32())})
        known = np.sort(np.frombuffer(b"".join(right.column("hashes").to_pylist()), np.uint64))
        every, piece, offset = hashes(left)
        places = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
        twice = known[places] == every if len(known) else np.zeros(len(every), bool)
        return _stretches(left, twice, piece, offset, window)

    ranges = pieces.groupBy("part", "shard").applyInArrow(cut, "part bigint, shard int, range int, hashes binary")
    back = stage(ranges.where(F.octet_length("hashes") > 0).groupBy("part", "range").applyInArrow(
        merge, "part bigint, shard int, hashes binary").where(F.octet_length("hashes") > 0), "suffix-merged")
    return pieces.groupBy("part", "shard").cogroup(back.groupBy("part", "shard")).applyInArrow(mark, _FOUND)


def repeated_strings(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    """Stretches of bytes, per row key, covered by windows that start at two places or more.

    Runs of windows are counted by their part's hash; only parts found twice go on. A run found twice as a whole is a
    repeat throughout. The distinct runs of each part are compared by suffix arrays: a shard holds all pieces of its
    parts, unless a part has over SHARD_PIECES of them; then it is dealt out and the shards' results are merged.
    """
    runs = stage(gathered_runs(rows, text_col, window, PART_BYTES, True), "suffix-runs")
    parts = stage(
        runs.groupBy("part").agg(F.count("*").alias("n_runs"), (F.min("whole") != F.max("whole")).alias("mixed"))
        .where("n_runs > 1").select("part", "mixed"), "suffix-parts")
    shared = stage(runs.join(parts, "part"), "suffix-shared")
    wholes = stage(
        shared.groupBy("part", "whole", "mixed").agg(
            F.count("*").alias("n_same"), F.min(F.struct(ID, ROW, "first", "n")).alias("sample")), "suffix-wholes")
    again = (
        shared.join(wholes.where("n_same > 1").select("part", "whole"), ["part", "whole"])
        .select(ID, ROW, "first", (F.col("n") + window - 1).alias("length"))
    )
    samples = wholes.where("mixed").select("part", "whole", "n_same", "sample.*")
    per_part = samples.groupBy("part").agg(F.count("*").alias("n_pieces"))
    heavy = stage(
        per_part.where(F.col("n_pieces") > SHARD_PIECES)
        .select("part", F.ceil(F.col("n_pieces") / SHARD_PIECES).cast("int").alias("of")), "suffix-heavy")
    pieces = stage(
        _pieces(rows, text_col, samples, window).join(heavy, "part", "left")
        .withColumn("shard", F.when(F.col("of").isNotNull(), F.pmod(F.xxhash64("whole"), F.col("of"))).cast("int")),
        "suffix-pieces")
    total = pieces.where("shard is null").agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def within(table: pa.Table) -> pa.Table:
        return _stretches(table, *repeated_in_shard(table.column("piece"), window), window)

    light = (
        pieces.where("shard is null").withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards)))
        .groupBy("shard").applyInArrow(within, _FOUND)
    )
    dealt = pieces.where("shard is not null")
    apart = dealt.groupBy("part", "shard").applyInArrow(within, _FOUND)
    return again.unionByName(light).unionByName(apart).unionByName(_merged_shards(dealt, window))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200) -> DataFrame:
    """``docs`` without the bytes of any string of ``window`` bytes that also starts anywhere else, this text included.

    ``text_col`` becomes the remaining UTF-8 bytes (binary: a cut may split a character); ``n_bytes``, ``n_removed`` and
    ``spans``, the maximal removed runs in order, are added; columns of those names are replaced. Strings are judged on
    the input, may overlap, and never cross texts. Null and empty texts, and texts shorter than a window, lose nothing.
    Repeated rows are repeats of each other and lose everything that is as long as a window.
    """
    rows = with_row_keys(docs.drop("n_bytes", "n_removed", "spans"), id_col, text_col)
    cut = with_stretches(rows, repeated_strings(rows, text_col, window), "__gm_cut")
    keep = [c for c in cut.columns if c not in (text_col, "__gm_cut", ID, ROW)]
    fields = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [
        f"`{text_col}` binary", "n_bytes bigint", "n_removed bigint", "spans array<struct<start: int, end: int>>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, losses, gaps = [], [], [], []
        for text, cuts in zip(utf8(batch.column(text_col)), batch.column("__gm_cut"), strict=True):
            removed, kept = [], text
            if cuts.is_valid:
                lost = W.covered(len(text), cuts.values.to_numpy())
                removed = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in W.spans(lost)), strict=True)]
                kept = np.frombuffer(text, np.uint8)[~lost].tobytes()
            texts.append(kept)
            sizes.append(len(text))
            losses.append(len(text) - len(kept))
            gaps.append(removed)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(losses, pa.int64()), pa.array(gaps, kind)],
            names=[*keep, text_col, "n_bytes", "n_removed", "spans"])

    return map_texts(cut, text_col, [*keep, "__gm_cut"], schema, step)
