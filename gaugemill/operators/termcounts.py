"""Word n-grams of tokenized rows, counted and looked up as numbers inside a task.

A row's words come from Spark as an array. A task numbers the words of a step and names an n-gram by the number of
its first words and its last word, so that only distinct n-grams of a step become strings again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one step works on; a row of more words is a step of its own.
STEP_WORDS = 1 << 21


def steps(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Consecutive slices of ``batch`` of about STEP_WORDS words, with all words and the row of each."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // STEP_WORDS
    cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        some = batch.slice(start, end - start)
        yield some, some.column(column).flatten(), np.repeat(np.arange(end - start), lengths[start:end])


def longer(at: np.ndarray, n: int, row: np.ndarray) -> np.ndarray:
    """Which n-grams, starting at the words ``at``, are followed by one more word of their row."""
    more = at + n < len(row)
    more[more] = row[at[more] + n] == row[at[more]]
    return more


def counted(words: pa.Array, row: np.ndarray, ngram_max: int) -> Iterator[pa.RecordBatch]:
    """Each distinct n-gram with the number of rows that hold it, ``df``, and of its occurrences, ``tf``."""
    numbers = words.dictionary_encode()
    names, word = numbers.dictionary, numbers.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at, key = np.arange(len(word)), word
    for n in range(1, ngram_max + 1):
        if n > 1:
            key = np.unique(key, return_inverse=True)[1] if n > 2 else key
            more = longer(at, n - 1, row)
            at, key = at[more], key[more]
            key = key * len(names) + word[at + n - 1]
        if not len(at):
            return
        order = np.argsort(key, kind="stable")  # rows stay in order
        ordered, rows = key[order], row[at[order]]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        fresh[1:] |= rows[1:] != rows[:-1]
        shown = at[order[first]]
        parts = [names.take(pa.array(word[shown + k])) for k in range(n)]
        yield pa.RecordBatch.from_arrays([
            pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0],
            pa.array(np.add.reduceat(fresh, first, dtype=np.int64)), pa.array(np.diff(np.append(first, len(order)))),
        ], names=["term", "df", "tf"])


class Terms:
    """Terms by their words: each prefix of a term is a node, found by the node before it and its last word."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.words = sorted({w for t in split for w in t})
        number = {w: i for i, w in enumerate(self.words)}
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # keys of the nodes in order, the term of each or -1
        node = np.zeros(len(terms), np.int64)
        sizes = np.array([len(t) for t in split])
        for n in range(1, int(sizes.max(initial=0)) + 1):
            has = np.flatnonzero(sizes >= n)
            key = node[has] * len(self.words) + np.array([number[split[i][n - 1]] for i in has])
            keys, node[has] = np.unique(key, return_inverse=True)
            term = np.full(len(keys), -1)
            whole = has[sizes[has] == n]
            term[node[whole]] = whole
            self.levels.append((keys, term))

    def found(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and term of every occurrence of a term."""
        numbers = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(numbers.dictionary, pa.array(self.words, numbers.dictionary.type)), -1)
        word = known.to_numpy(zero_copy_only=False).astype(np.int64)[numbers.indices.to_numpy(zero_copy_only=False)]
        at, node, rows, terms = np.flatnonzero(word >= 0), None, [], []
        for n, (keys, term) in enumerate(self.levels, 1):
            if n > 1:
                more = longer(at, n - 1, row)
                at, node = at[more], node[more]
                more = word[at + n - 1] >= 0
                at, node = at[more], node[more]
            key = word[at + n - 1] if node is None else node * len(self.words) + word[at + n - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, node = at[hit], place[hit]
            whole = term[node] >= 0
            rows.append(row[at[whole]])
            terms.append(term[node[whole]])
        return np.concatenate(rows), np.concatenate(terms)


def weighted(rows: np.ndarray, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every term in every row; a row's weights have the length 1."""
    key, tf = np.unique(rows * len(idf) + terms, return_counts=True)
    row, term = key // len(idf), key % len(idf)
    weight = tf * idf[term]
    length = np.sqrt(np.bincount(row, weight * weight))
    return row, term, weight / length[row]
