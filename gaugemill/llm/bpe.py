"""Byte-level BPE by a monoid of encoded strings: halves are encoded apart and joined at their seam."""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gaugemill.llm.common import give_back, map_texts

#: Bytes that are merged directly; longer strings are halved.
LEAF_BYTES = 16
#: Tokens of longer strings are not remembered, nor more strings than this.
REMEMBERED_BYTES, REMEMBERED = 48, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read once on the driver: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Monoid:
    """Token sequences of byte strings under ``join``.

    A sequence is the encoding of its bytes exactly if every two neighbours are *settled*: encoded together they stay
    two tokens. A merge crossing a seam would have to be the merge of some pair there, and merges inside a token do not
    depend on what lies outside. So ``join`` re-encodes a window around the seam and grows it on the side that is not
    settled until both edges are; nothing beyond can change.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.known: dict[bytes, tuple[bytes, ...]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges by rank, lowest and leftmost first."""
        if text in self.ranks:
            return [text]
        if len(text) > 8 * LEAF_BYTES:
            return self._merged_by_heap(text)
        parts, rank = [text[i:i + 1] for i in range(len(text))], self.ranks.get
        after = [rank(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while after:
            best = min(after)
            if best == 1 << 60:
                break
            at = after.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del after[at]
            if at < len(after):
                after[at] = rank(parts[at] + parts[at + 1], 1 << 60)
            if at:
                after[at - 1] = rank(parts[at - 1] + parts[at], 1 << 60)
        return parts

    def _merged_by_heap(self, text: bytes) -> list[bytes]:
        """The same for a long window, in n log n steps: of few distinct bytes, say."""
        size, rank = len(text), self.ranks.get
        ends, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := rank(text[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = ends[start]
            if middle < 0 or middle >= size or ends[middle] != end or end <= middle:
                continue  # one of the two has been merged since
            ends[start], ends[middle] = end, -1
            if end < size:
                before[end] = start
                if (r := rank(text[start:ends[end]])) is not None:
                    heapq.heappush(heap, (r, start, ends[end]))
            if before[start] >= 0 and (r := rank(text[before[start]:end])) is not None:
                heapq.heappush(heap, (r, before[start], end))
        parts, at = [], 0
        while at < size:
            parts.append(text[at:ends[at]])
            at = ends[at]
        return parts

    def settled(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = self.merged(b"".join(left[i:] + right[:j]))
            low = i == 0 or self.settled(left[i - 1], window[0])
            high = j == len(right) or self.settled(window[-1], right[j])
            if low and high:
                return left[:i] + window + right[j:]
            # the window doubles on the unsettled side, so that all windows together stay linear in the last one
            width = len(left) - i + j
            i = i if low else max(0, i - width)
            j = j if high else min(len(right), j + width)

    def tokens(self, text: bytes) -> list[bytes]:
        """The encoding of one string: both halves', joined. Halving ends after log2 of its length."""
        if len(text) <= LEAF_BYTES:
            return self.merged(text) if text else []
        half = len(text) // 2
        return self.join(self.tokens(text[:half]), self.tokens(text[half:]))

    def packed(self, piece: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        ids = self.known.get(piece)
        if ids is None:
            found = self.tokens(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *map(self.ranks.__getitem__, found))
            if len(piece) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids


#: Of this Python worker, by vocabulary: tasks that follow in the same worker find it built.
_built: dict[int, Monoid] = {}


def _monoid(ranks: dict[bytes, int], key: int) -> Monoid:
    if key not in _built:
        _built.clear()
        _built[key] = Monoid(ranks)
    return _built[key]


def _with_binary(df: DataFrame, column: str) -> tuple[list[str], str]:
    keep = [c for c in df.columns if c != column]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return keep, ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"`{column}` binary"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_as: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens; a null or empty text has no ids. Rows are
    independent, so repeated ones get equal ids. ``ids_as`` replaces a column of that name. Every byte must be a token.
    """
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    key = hash(tuple(sorted(ranks.items())[:64])) ^ len(ranks)
    docs = docs.drop(*([ids_as] if ids_as != text_col else []))
    keep = [c for c in docs.columns if c != text_col]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [*keep, text_col, ids_as]
    schema = ", ".join([f"`{c}` {fields[c]}" for c in [*keep, text_col]] + [f"`{ids_as}` binary"])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        monoid, pieces = _monoid(shared.value, key), regex.compile(pattern).findall
        texts = part.column(text_col)
        ids = [b"".join(map(monoid.packed, pieces(t))) if t else b"" for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts, pa.array(ids, pa.binary())], names=names)

    return map_texts(docs, text_col, keep, schema, step)


def concatenated(parts: list[bytes]) -> bytes:
    """``parts`` in order, joined by halves up a tree of which the leaves hold a few thousand parts."""
    if len(parts) <= 4096:
        return b"".join(parts)
    half = len(parts) // 2
    return concatenated(parts[:half]) + concatenated(parts[half:])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_as: str = "decoded") -> DataFrame:
    """``encoded`` with ``ids_col`` replaced by the bytes its ids stand for; a null has none. An id out of the vocabulary raises."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    encoded = encoded.drop(*([bytes_as] if bytes_as != ids_col else []))
    keep, schema = _with_binary(encoded.withColumnRenamed(ids_col, bytes_as), bytes_as)
    limit = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, limit):
                part = batch.slice(start, limit)
                texts = [concatenated(list(map(token, np.frombuffer(i or b"", "<u4").tolist())))
                         for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.binary())],
                                                 names=[*keep, bytes_as])
        give_back()

    return encoded.select(*keep, ids_col).mapInArrow(run, schema)


def id_list(ids: bytes) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(ids, "<u4").tolist()


