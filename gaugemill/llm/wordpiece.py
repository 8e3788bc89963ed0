"""Greedy word-piece counts by a linear automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugemill.llm.common import map_texts, utf8

#: What marks the first piece of a word in the vocabulary.
WORD_MARK = "▁"
#: Words whose counts a worker remembers.
REMEMBERED = 200_000


def read_pieces(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model, without controls, unknowns and bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """Longest match first, in one walk over a word.

    States are nodes of two tries: of first pieces and, from ``INNER`` on, of later ones. ``fail`` is where the walk goes
    on once no longer piece can match, ``popped`` how many pieces that completes; both are computed once, breadth first.

    With ``whole`` every piece counts and a word is matched with its mark: the bare mark is a piece, so that a word none of
    whose first characters stands behind a mark goes on with later pieces, and marks inside words match like any character.
    Without, as in WordPiece vocabularies, which have no such piece, the bare mark and pieces with further marks are left out.
    """

    FIRST, INNER, NONE = 0, 1, -1

    def __init__(self, pieces: Iterable[str], mark: str = WORD_MARK, whole: bool = False):
        self.next: list[dict[str, int]] = [{}, {}]
        ends, parent = {}, {}
        for piece in pieces:
            first = piece.startswith(mark)
            body = piece[len(mark):] if first else piece
            if not whole and (not body or mark in body):
                continue
            ways = [(self.FIRST, body)] if first else [(self.INNER, body)]
            if whole and first:
                ways.append((self.INNER, piece))
            for state, rest in ways:
                for char in rest:
                    to = self.next[state].get(char)
                    if to is None:
                        to = self.next[state][char] = len(self.next)
                        self.next.append({})
                        parent[to] = (state, char)
                    state = to
                ends[state] = True
        size = len(self.next)
        self.fail, self.popped = [self.NONE] * size, [0] * size
        todo = deque([self.FIRST, self.INNER])
        while todo:
            state = todo.popleft()
            todo.extend(self.next[state].values())
            if state in ends:
                self.fail[state], self.popped[state] = self.INNER, 1
            elif state in parent:
                above, char = parent[state]
                at, popped = self.fail[above], self.popped[above]
                while at != self.NONE and char not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at != self.NONE:
                    self.fail[state], self.popped[state] = self.next[at][char], popped

    def count(self, word: str) -> int:
        """Pieces of ``word``, or 0 if greedy matching gets stuck and the word is one unknown token."""
        state, pieces = self.FIRST, 0
        next_, fail, popped = self.next, self.fail, self.popped
        for char in word:
            to = next_[state].get(char)
            while to is None:
                pieces += popped[state]
                state = fail[state]
                if state == self.NONE:
                    return 0
                to = next_[state].get(char)
            state = to
        while state != self.INNER:
            pieces += popped[state]
            state = fail[state]
            if state == self.NONE:
                return 0
        return pieces


#: Of this Python worker, by vocabulary: the automaton, and counts of words that it has walked.
_built: dict[int, tuple[Automaton, dict[bytes, int]]] = {}


def _worker(pieces: list[str], whole: bool, key: int) -> tuple[Automaton, dict[bytes, int]]:
    if key not in _built:
        _built.clear()
        _built[key] = (Automaton(pieces, whole=whole), {})
    return _built[key]


def _counts(text: bytes, automaton: Automaton, known: dict[bytes, int]) -> tuple[int, int, int]:
    words, found = text.split(), []
    for word in words:
        n = known.get(word)
        if n is None:
            if len(known) >= REMEMBERED:
                known.clear()
            n = known[word] = automaton.count(word.decode())
        found.append(n)
    unknown = found.count(0)
    return len(words), sum(found) + unknown, unknown


def count_tokens(
    docs: DataFrame, pieces: list[str], keep: list[str], text_col: str = "text", whole: bool = False,
) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``n_tokens`` and ``n_unknown`` of every whole text.

    A word whose pieces cannot be matched counts as one token and as unknown. With ``whole`` all pieces are used, the bare
    mark too; without, a word that starts with a character no marked piece has is unknown. Null and empty texts count 0.
    Rows are independent. Columns in ``keep`` must not bear the names of the counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary
    key = hash((whole, *pieces))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = ["n_words", "n_tokens", "n_unknown"]
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"{n} bigint" for n in names])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        worker = _worker(shared.value, whole, key)
        columns = zip(*(_counts(t, *worker) for t in utf8(part.column(text_col))), strict=True)
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *names])

    return map_texts(docs, text_col, keep, schema, step)
