"""Two tokenizers side by side: where their tokens end together, and how often in the corpus two tokens overlap."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import SLICE_BYTES, give_back, slices
from gaugemill.llm.perfecthash import PerfectHash
from gaugemill.llm.windows import mixed
from gaugemill.session import discard, stage

#: Distinct pairs whose counts one pass over the texts looks up: keys and counts of 16 bytes each, 64 MB in all.
#: More pairs take more passes, each over its share of the pairs.
BAND = 4_000_000
#: Distinct pairs for which one task builds a hash, on average.
SHARD = 1 << 17
#: Counts in one piece of a vector, and vectors that are added up at a time.
BLOCK, FAN_IN = 1 << 16, 8
#: Units whose alignment a worker remembers, and distinct pairs a task holds before it passes their counts on.
REMEMBERED, HELD = 600_000, 1_000_000

#: A text may be cut before a blank that stands between a visible ASCII or Latin-1 sign and a letter: no match of the first
#: tokenizer's pattern runs over such a place, and no piece of the second has a mark behind another sign.
_SAFE = re.compile("(?<=[!-~À-ÿ]) (?=[A-Za-zÀ-ÖØ-öø-ÿ])")
_VISIBLE, _LETTERS = (frozenset(c for c in map(chr, range(256)) if re.match(x, c)) for x in ("[!-~À-ÿ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"))
#: Units that are encoded side by side.
TOGETHER = 128


@cache
def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as signs from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the alignment of units of text that have been met.

    A *unit* is a stretch between safe cuts. Tokens of both end at its ends, so its groups and links are the same in every
    text, and a text is the sequence of its units.
    """

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_level)
        self.first.encode_special_tokens = True
        signs, vocabulary = _byte_of_sign(), self.first.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(map(signs.__getitem__, token))
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cut = not any("▁" in p.lstrip("▁") for p in names)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # ids as text: of the first inside a group and at its end, of the second likewise
        self.names = [f"{i}{end}" for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(x))]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)  # of a unit: tokens of both, groups, links; -1 groups where bytes differ
        self.pool = np.zeros(0, np.int64)  # the links of all units
        self.starts = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def learn(self, units: list[str], with_groups: bool = True) -> None:
        new = list(dict.fromkeys(u for u in units if u not in self.known))
        if not new:
            return
        # units that could stand side by side in a text are encoded so, many at a time
        side = [u for u in new if u[0] in _LETTERS and u[-1] in _VISIBLE] if self.cut else []
        alone = [u for u in new if not (u[0] in _LETTERS and u[-1] in _VISIBLE)] if self.cut else new
        together = [" ".join(side[k:k + TOGETHER]) for k in range(0, len(side), TOGETHER)]
        new = side + alone
        texts = [b" " + u.encode() for u in new]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        a, b = self._encoded(together + alone)
        whole = b"".join(texts)
        good = np.ones(len(new), bool)
        if b"".join(map(self.a_bytes.__getitem__, chain.from_iterable(a))) != whole or b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))) != whole:
            a, b = self._encoded(new)
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y))
                             for x, y, t in zip(a, b, texts, strict=True)], bool)
            a, b, sizes = compress(a, good), compress(b, good), sizes[good]
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        counts, links, groups = self._aligned(*flat, sizes, with_groups)
        rows = np.zeros((len(new), 4), np.int64)
        rows[:, 2] = -1
        rows[good] = counts
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(rows[:, 3]) - rows[:, 3]])
        self.counts, self.pool = np.concatenate([self.counts, rows]), np.concatenate([self.pool, links])
        if with_groups:
            text_of = iter(groups)
            self.groups.extend(groups if good.all() else [next(text_of) if g else "" for g in good.tolist()])

    def _encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        firsts = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in firsts], self.second.encode(texts, num_threads=1)

    def _aligned(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, with_groups: bool):
        """Counts of each unit, the links of all, and each unit's groups as text. Units lie end to end; all their ends are common."""
        total = int(sizes.sum())
        is_a, is_b = np.zeros(total, bool), np.zeros(total, bool)
        end_a, end_b = np.cumsum(self.a_sizes[a]) - 1, np.cumsum(self.b_sizes[b]) - 1
        is_a[end_a], is_b[end_b] = True, True
        both, ends = is_a & is_b, np.cumsum(sizes) - 1
        if not both[ends].all():
            raise ValueError("a token runs over the end of a unit")
        # a pair overlaps up to the nearer end of its two tokens, so each end of either closes one link
        upto_a, upto_b, upto_both = np.cumsum(is_a), np.cumsum(is_b), np.cumsum(both)
        at = np.flatnonzero(is_a | is_b)
        in_a, in_b = upto_a - is_a, upto_b - is_b
        links = a[in_a[at]] << 32 | b[in_b[at]]
        n_a, n_b, n_groups = (np.diff(upto[ends], prepend=0) for upto in (upto_a, upto_b, upto_both))
        counts = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups], axis=1)
        if not with_groups:
            return counts, links, []
        common = np.flatnonzero(both)
        a_upto, b_upto = np.concatenate([[0], upto_a[common]]), np.concatenate([[0], upto_b[common]])
        group_a, group_b = (upto_both - both)[end_a], (upto_both - both)[end_b]
        order_a, order_b = np.arange(len(a)), np.arange(len(b))
        names = np.empty(len(a) + len(b), np.int64)
        n = len(self.a_bytes)
        names[order_a + b_upto[group_a]] = a + np.where(order_a + 1 == a_upto[group_a + 1], n, 0)
        names[order_b + a_upto[group_b + 1]] = 2 * n + b + np.where(order_b + 1 == b_upto[group_b + 1], len(self.b_bytes), 0)
        parts = list(map(self.names.__getitem__, names.tolist()))
        cuts = [0, *np.cumsum(n_a + n_b).tolist()]
        return counts, links, ["".join(parts[s:e])[:-1] for s, e in zip(cuts, cuts[1:], strict=False)]

    def links_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All links of these units one after the other, and how many each has."""
        n = self.counts[units, 3]
        return self.pool[np.repeat(self.starts[units] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    def units(self, text: str) -> list[str]:
        return _SAFE.split(text) if self.cut else [text]

    def numbers(self, texts: list[str | None], with_groups: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts by number, and how many each text has: none if it is null, empty or not rendered byte for byte."""
        if len(self.known) >= REMEMBERED:
            self.clear()
        cut = [self.units(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.learn(flat, with_groups)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        found = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        wrong = self.counts[found, 2] < 0
        if wrong.any():  # the contract is on the joined bytes of a whole text
            rows = np.split(found, np.cumsum(sizes)[:-1])
            bad = np.unique(np.repeat(np.arange(len(texts)), sizes)[wrong]).tolist()
            self.learn([texts[k] for k in bad], with_groups)
            for k in bad:
                whole = self.known[texts[k]]
                rows[k] = np.array([whole] if self.counts[whole, 2] >= 0 else [], np.int64)
            found, sizes = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return found, sizes


#: Of this Python worker, by what it was built from.
_built: dict[tuple[int, bool], Aligner] = {}


def _aligner(files, with_groups: bool = True) -> Aligner:
    key = hash(files.value), with_groups  # passes with and without the groups' texts do not share units
    if key not in _built:
        _built.clear()
        _built[key] = Aligner(*files.value)
    return _built[key]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    together, at = np.unique(np.concatenate(keys), return_inverse=True)
    return together, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def pair_counts(docs: DataFrame, files, text_col: str = "text") -> DataFrame:
    """``pair`` (first id * 2**32 + second id) and in how many texts of a task it is linked, ``n``: a row a task and flush."""
    limit, held = SLICE_BYTES, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def passed_on() -> pa.RecordBatch:
            found, n = _summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for part in slices(batch, text_col, limit):
                aligner = _aligner(files, False)
                units, sizes = aligner.numbers(part.column(text_col).to_pylist(), False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                distinct = np.unique(row * len(aligner.counts) + units)
                links, lengths = aligner.links_of(distinct % max(1, len(aligner.counts)))
                if not len(links):
                    continue
                found, at = np.unique(links, return_inverse=True)
                n = np.bincount(np.unique(np.repeat(distinct // len(aligner.counts), lengths) * len(found) + at) % len(found), minlength=len(found))
                keys.append(found)
                counts.append(n)
                if sum(map(len, keys)) >= held:
                    found, n = _summed(keys, counts)
                    keys, counts = [found], [n]
                    if len(found) >= held // 2:
                        yield passed_on()
                        keys, counts = [], []
        if keys:
            yield passed_on()
        keys.clear()
        give_back()

    return docs.select(text_col).mapInArrow(run, "pair bigint, n bigint")


class _Shards:
    """The hash of all pairs of a band: a minimal perfect hash for each shard, numbers running on from shard to shard."""

    def __init__(self, first: int, shards: int, rows: list):
        self.first, self.bits = first, shards.bit_length() - 1
        self.at, before = {}, 0
        for row in sorted(rows, key=lambda r: r.shard):
            self.at[row.shard] = (before, PerfectHash.unpacked(row.levels))
            before += row.size
        self.n = before
        self.offsets = {shard: start for shard, (start, _) in self.at.items()}

    def index(self, pairs: np.ndarray) -> np.ndarray:
        found, shard = np.full(len(pairs), -1, np.int64), _shard_of(pairs, self.bits)
        order = np.argsort(shard, kind="stable")
        values, starts = np.unique(shard[order], return_index=True)
        for value, group in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            if value in self.at:
                start, hashed = self.at[value]
                at = hashed.index(pairs[group].view(np.uint64))
                found[group] = np.where(at >= 0, at + start, -1)
        return found


def _shard_of(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(pairs.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)


def _hashes(counted: DataFrame, shards: int) -> DataFrame:
    """Per shard its distinct pairs: how many, the levels of their hash, and the pairs by number."""
    bits = shards.bit_length() - 1

    def with_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pair").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(_shard_of(pairs, bits))], names=["pair", "shard"])

    def build(table: pa.Table) -> pa.Table:
        pairs = table.column("pair").to_numpy()
        hashed, ordered = PerfectHash.of(pairs.view(np.uint64)), np.empty(len(pairs), "<i8")
        ordered[hashed.index(pairs.view(np.uint64))] = pairs
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "size": pa.array([len(pairs)], pa.int64()),
            "levels": pa.array([hashed.packed()], pa.list_(pa.binary())), "pairs": pa.array([ordered.tobytes()], pa.binary())})

    distinct = counted.select("pair").distinct().mapInArrow(with_shard, "pair bigint, shard bigint")
    return distinct.groupBy("shard").applyInArrow(build, "shard bigint, size bigint, levels array<binary>, pairs binary")


def _vectors(counted: DataFrame, shared, tasks: int) -> DataFrame:
    """The counts of all pairs of a band as one dense vector in blocks: each task's vectors, added up a tree of FAN_IN."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, _ = shared.value
        vector, leaf_of = np.zeros(shards.n, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            at = shards.index(batch.column("pair").to_numpy())
            np.add.at(vector, at[at >= 0], batch.column("n").to_numpy()[at >= 0])
        for block in range(0, shards.n, BLOCK):
            part = vector[block:block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block // BLOCK], pa.int64()), pa.array([leaf_of], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                    names=["block", "leaf", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1], "leaf": pa.array([table.column("leaf")[0].as_py() // FAN_IN], pa.int64()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block bigint, leaf bigint, counts binary"
    vectors = stage(counted.coalesce(tasks).mapInArrow(leaf, schema), "alignment-vectors")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        before, vectors = vectors, stage(
            vectors.withColumn("to", F.expr(f"leaf div {FAN_IN}")).groupBy("block", "to").applyInArrow(add, schema), "alignment-vectors")
        discard(before)
    return vectors


def align(
    docs: DataFrame, byte_level: str, pieces: bytes, text_col: str = "text", band: int | None = None, groups_as: str = "groups",
) -> DataFrame:
    """``docs`` without the text, with how the tokens of two tokenizers lie to each other in it.

    ``byte_level`` is the JSON of a byte-level BPE vocabulary, which encodes a blank and the text; ``pieces`` is a piece
    model that puts the blank itself. Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_as``, the groups as text, replacing columns of those names. Places where tokens of both end cut them into groups;
    tokens that overlap are linked. The count of a pair of ids is in how many rows they are linked; ``n_best`` are the links whose
    count is the highest of their first id. Texts that are null or empty, or not rendered byte for byte by both, have no tokens: zeros and ''.
    Equal rows count each. Special tokens inside texts are plain text.

    Pairs are counted once through: each task counts the texts of its own pairs, the distinct pairs get numbers by a minimal
    perfect hash, and vectors of counts by number are added up a tree. A second pass aligns the texts anew and looks counts
    up; the pair kept under a number proves that it is the one. Tables for up to ``band`` pairs are held at a time; if there
    are more, each band of pairs takes a pass of its own, adding its links' figures.
    """
    spark, band = docs.sparkSession, band or BAND
    files = spark.sparkContext.broadcast((byte_level, pieces))  # two vocabularies
    added = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", groups_as: "string"}
    docs = docs.drop(*(c for c in added if c != text_col))
    counted = stage(pair_counts(docs, files, text_col), "alignment-counted")
    entries = counted.count()
    distinct = counted.select("pair").distinct().count()
    shards = 1 << max(0, (-(-distinct // SHARD) - 1).bit_length())
    hashes = stage(_hashes(counted, shards), "alignment-hashes")
    sizes = sorted((r.shard, r.size) for r in hashes.select("shard", "size").collect())  # a row for 131,072 pairs
    bands: list[list[int]] = []
    for shard, size in sizes:
        if not bands or held + size > band:  # noqa: F821 set with the first band
            bands.append([])
            held = 0
        bands[-1].append(shard)
        held += size
    best = np.zeros(0, np.int64)
    tables = []
    for chosen in bands:
        own = hashes.where(F.col("shard").between(chosen[0], chosen[-1]))
        rows = own.collect()
        known = _Shards(chosen[0], shards, rows)
        pairs = np.concatenate([np.frombuffer(r.pairs, "<i8") for r in sorted(rows, key=lambda r: r.shard)])
        shared = spark.sparkContext.broadcast((known, None))
        vectors = _vectors(counted, shared, max(1, entries // max(known.n, 1)))
        counts = np.zeros(known.n, np.int64)
        for r in vectors.select("block", "counts").collect():  # once the counts of a band
            counts[r.block * BLOCK:r.block * BLOCK + BLOCK] = np.frombuffer(r.counts, np.int64)
        discard(vectors)
        shared.unpersist()
        firsts = pairs >> 32
        more = np.zeros(max(len(best), int(firsts.max()) + 1), np.int64)
        more[:len(best)] = best
        np.maximum.at(more, firsts, counts)
        best = more
        tables.append((known, pairs, counts))
    discard(counted, hashes)
    return _looked_up(docs, files, text_col, tables, best, added, groups_as)


def _looked_up(docs: DataFrame, files, text_col: str, tables: list, best: np.ndarray, added: dict[str, str], groups_as: str) -> DataFrame:
    """The second pass, or one for each band; figures of links are added to those of the bands before."""
    spark, limit = docs.sparkSession, SLICE_BYTES
    keep = [c for c in docs.columns if c != text_col]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def looked_up(given: DataFrame, shared, first: bool, last: bool) -> DataFrame:
        kept = [*keep, *([] if last else [text_col])]
        before = [] if first else ["n_best", "count_sum"]
        schema = ", ".join([f"`{c}` {fields[c]}" for c in kept] + [f"`{c}` {t}" for c, t in added.items()])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            aligner = _aligner(files)
            found, sizes = aligner.numbers(batch.column(text_col).to_pylist())
            units, of = np.unique(found, return_inverse=True)
            per_unit = np.zeros((len(units) + 1, 6), np.int64)
            per_unit[:-1, :4] = aligner.counts[units]
            links, lengths = aligner.links_of(units)
            if shared is not None and len(links):
                known, keys, all_counts, top = shared.value
                pairs, at = np.unique(links, return_inverse=True)
                number = known.index(pairs)
                sure = (number >= 0) & (keys[np.maximum(number, 0)] == pairs)
                counts = np.where(sure, all_counts[np.maximum(number, 0)], 0)
                is_best = sure & (counts == top[np.minimum(pairs >> 32, len(top) - 1)])
                starts = np.cumsum(lengths) - lengths
                per_unit[:-1, 4] = np.add.reduceat(is_best.astype(np.int64)[at], starts)
                per_unit[:-1, 5] = np.add.reduceat(counts[at], starts)
            running = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(per_unit[of], axis=0)])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = running[ends[1:]] - running[ends[:-1]]
            for k, name in enumerate(before):
                sums[:, 4 + k] += batch.column(name).to_numpy()
            texts = list(map(aligner.groups.__getitem__, found.tolist()))
            groups = [";".join(texts[s:e]) for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(sums[:, k]) for k in range(6)), pa.array(groups, pa.string())],
                names=[*kept, *added])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, limit):
                    yield step(part)
            give_back()

        return given.select(*keep, text_col, *before).mapInArrow(run, schema)

    if not tables:
        return looked_up(docs, None, True, True)
    for k, (known, pairs, counts) in enumerate(tables):
        shared = spark.sparkContext.broadcast((known, pairs, counts, best))  # at most a band
        last = k == len(tables) - 1
        out = looked_up(docs, shared, k == 0, last)
        docs = out if last else stage(out, "alignment-bands")
    return docs


def groups_hash(column: str = "groups"):
    """SHA-256 of the groups as text, '' where there are none."""
    return F.when(F.col(column) == "", F.lit("")).otherwise(F.sha2(F.col(column).cast("binary"), 256))

