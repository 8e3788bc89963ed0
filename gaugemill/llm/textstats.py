"""One pass over each text that takes every measurement the rules and the classifier use."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugemill.llm.common import map_texts, utf8

#: Measurements in column order; all are whole numbers.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
    "n_distinct_words", "n_stops", "n_marks",
)
SYMBOLS, STOPS, MARKS = b"#*$%&|<>", b".?,;:", b"!"
_UPPER, _DIGITS, _BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r"
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more in the text, the first of them included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def measures_of(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: exactly the blanks 20 and 09 to 0D
    without = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), len(text.decode()) - without(_BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), without(_UPPER), without(_DIGITS), len(set(words)), without(STOPS), without(MARKS),
    )


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and its measurements as longs; a null text measures as an empty one."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"{m} bigint" for m in MEASURES])

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [measures_of(t) for t in utf8(part.column(text_col))]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *MEASURES])

    return map_texts(docs, text_col, keep, schema, step)
