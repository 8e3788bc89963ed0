"""SimHash fingerprints of shingles, and the groups formed by those few bits apart, found by covering masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import ID, ROW, map_texts, with_row_keys
from gaugemill.llm.groups import components
from gaugemill.session import discard, stage

BITS = 64
#: Different fingerprints of one bucket that are compared with each other; a larger bucket is masked further.
MOST_COMPARED = 32
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
_ALL = (1 << BITS) - 1


def fingerprint_of(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 hashes of a text's shingles; zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    whole, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(size, len(words))
    starts, ends = (ends - lengths)[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(whole[s:e], seed) for s, e in zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3, seed: int = 42, as_: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed 64-bit integer; a column ``as_`` is replaced."""
    keep = [c for c in docs.columns if c not in (text_col, as_)]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in [*keep, text_col]] + [f"`{as_}` bigint"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col)
        found = np.array([fingerprint_of(t, size, seed) for t in texts.to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts, pa.array(found.view(np.int64))], names=[*keep, text_col, as_])

    return map_texts(docs, text_col, keep, schema, step)


def masks_below(fixed: int, radius: int) -> list[int]:
    """Masks that keep the bits ``fixed`` and some of the others, so that any ``radius`` others miss one mask at least.

    Every free bit has a vector of radius + 1 bits, not zero, and mask v takes the bits whose vectors have an odd number of
    ones in common with v. The vectors of ``radius`` bits leave a v that is orthogonal to them all: its mask has none of
    them. Unit vectors come first, so each mask takes a free bit if there are radius + 1.
    """
    width = radius + 1
    vectors = sorted(range(1, 1 << width), key=lambda v: (v.bit_count() != 1, v))
    free = [i for i in range(BITS) if not fixed >> i & 1]
    return [
        fixed | sum(1 << bit for k, bit in enumerate(free) if (vectors[k % len(vectors)] & v).bit_count() & 1)
        for v in range(1, 1 << width)
    ]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def close_pairs(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs a < b of the distinct 64-bit integers ``node`` that differ in 1 to ``radius`` bits.

    Two such meet in a bucket (mask, bits under it) of the covering masks. A bucket with more than MOST_COMPARED of them is
    not compared: its members differ in free bits only, so they are met again under masks that fix some of those, until
    every bucket is small. With five free bits it cannot be larger, so this ends, and no entry meets more than
    MOST_COMPARED others in a bucket however many fingerprints look alike.
    """
    spark, level, found = nodes.sparkSession, [0], []
    entries = nodes.select("node", F.lit(0).cast("long").alias("mask"))
    while True:
        below = {m: masks_below(m, radius) for m in level}
        steps = spark.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in below.items()], "mask long, next array<long>")
        masked = (
            entries.join(F.broadcast(steps), "mask")  # as many rows as masks of this level: 1, 15, 225
            .select("node", F.explode("next").alias("mask")).withColumn("key", F.col("node").bitwiseAND(F.col("mask")))
        )
        masked = masked.distinct() if level != [0] else masked  # two masks may lead to one
        buckets = stage(masked.groupBy("mask", "key").agg(F.count("*").alias("k")).where("k > 1"), "covering-buckets")
        small = masked.join(buckets.where(f"k <= {MOST_COMPARED}").select("mask", "key"), ["mask", "key"])
        left, right = small.withColumnRenamed("node", "a"), small.withColumnRenamed("node", "b")
        met = left.join(right, ["mask", "key"]).where(F.expr(f"a < b and bit_count(a ^ b) <= {radius}"))
        found.append(stage(met.select("a", "b").distinct(), "covering-pairs"))
        large = buckets.where(f"k > {MOST_COMPARED}").select("mask", "key")
        ended = large.isEmpty()
        before, entries = entries, None if ended else stage(masked.join(large, ["mask", "key"]).select("node", "mask"), "covering-open")
        discard(before, buckets)
        if ended:
            break
        level = sorted({x for xs in below.values() for x in xs})
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def near_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3,
    fingerprint_as: str = "fingerprint", group_as: str = "component_id",
) -> DataFrame:
    """The columns of ``docs`` but the text, with each text's fingerprint and the smallest id that links lead to.

    Two rows link if their fingerprints differ in at most ``radius`` bits. Words are A-Z lower-cased; a text of fewer than
    ``size`` words is one shingle. Null texts and texts without words have the fingerprint zero and link like any other.
    Equal fingerprints are one node, so copies are never paired. A null id counts as the largest; rows of one id and equal
    rows are rows like any other. No row is dropped. ``fingerprint_as`` and ``group_as`` replace columns of those names.
    """
    keep = [c for c in docs.columns if c not in (fingerprint_as, group_as, text_col)]
    rows = with_row_keys(docs.select(*keep, text_col), id_col, text_col).drop(ROW)
    rows = stage(with_fingerprints(rows, text_col, size, as_=fingerprint_as).drop(text_col), "covering-rows")
    known = stage(rows.select(ID, F.col(fingerprint_as).alias("node")).groupBy("node").agg(F.min(ID).alias("least")), "covering-nodes")
    labels = components(close_pairs(known.select("node"), radius))
    grouped = stage(known.join(labels, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "covering-grouped")
    smallest = grouped.groupBy("comp").agg(F.min("least").alias(group_as))
    named = grouped.join(smallest, "comp").select(F.col("node").alias(fingerprint_as), group_as)
    return rows.join(named, fingerprint_as).select(*keep, fingerprint_as, group_as)
