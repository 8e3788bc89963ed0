"""Words, rows and Arrow batches as every operator of this subpackage sees them.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``; a null text is an empty one. A null id counts as the
largest id. Two rows of one id are told apart by their texts; rows equal in both get equal results.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy step works on; one longer text is a step of its own.
SLICE_BYTES = 1 << 20

#: Names that these operators add on the way; a caller's columns of these names are not supported.
ID, ROW = "__gm_id", "__gm_row"


def with_row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the id that orders rows and the key that tells apart rows of one id."""
    return docs.withColumns({
        ID: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
        ROW: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that clash with ``names`` renamed, and what they were called: withColumnsRenamed undoes it."""
    taken = {n.lower() for n in names}
    renamed = {c: f"__gm_own_{c}" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(renamed), {new: old for old, new in renamed.items()}


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def map_texts(
    df: DataFrame, text_col: str, keep: list[str], schema: str, step: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> DataFrame:
    """``step`` over slices of rows that hold about SLICE_BYTES of text, with the columns ``keep`` and the text."""
    limit = SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, limit):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.select(*keep, text_col).mapInArrow(run, schema)


def give_back() -> None:
    """Return the memory that a task has freed to the system. Workers outlive tasks, and several wait idle on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose texts together stay near ``limit`` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins (one entry more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes, a null as none."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[n], pa.Array) else pa.array(c, type=t) for n, t in types.items()], names=list(types),
    )
