"""Columnar text helpers shared by the Arrow-side operators of this subpackage.

Every helper works on a whole Arrow batch as one byte buffer with row offsets, so that the per-row Python cost stays
small. Null texts are empty texts here; no text is ever cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeworks.sources.shared import bounded, ensure_checkpoint_dir, shared_dir  # noqa: F401

#: Fixed values of the contracts: ASCII white space, and the bytes of words in lower-cased text.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()


def mapped(data: np.ndarray | bytes, table: np.ndarray | bytes) -> np.ndarray:
    """table[data] for bytes, at the speed of bytes.translate."""
    raw = data if isinstance(data, bytes) else data.tobytes()
    return np.frombuffer(raw.translate(table if isinstance(table, bytes) else table.astype(np.uint8).tobytes()), np.uint8)


#: Bytes of text that an operator handles at once in a Python worker.
SLICE_BYTES = 2 << 20


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system, as workers are kept for other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: only the worker's size depends on it
        pass


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; others, whatever their names, are left out (and pruned from the scan)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 rows) of a string or binary column; null rows are empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut between rows so that one holds about `most` bytes of text (column 1), with its bytes and offsets."""
    for batch in batches:
        data, offsets = row_bytes(batch.column(1))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
            last = min(batch.num_rows, max(first + 1, last))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def map_slices(docs: DataFrame, make: Callable[[], Callable], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices: make() gives, once a task, a function of (doc_ids, bytes, offsets) that returns arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for part, data, offsets in slices(batches, most):
                out = step(part.column(0), data, offsets)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
        finally:
            give_back()

    return docs.mapInArrow(run, schema)


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all) of maximal runs of bytes with inside[byte]; runs end at row ends."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = mapped(data, inside).view(bool)
    return runs_of(mask, mask[1:] & ~mask[:-1], offsets)


def runs_of(inside: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words_of, for a mask and the places (from 1 on) where a run begins; a run also begins at the start of a row."""
    first = np.empty(len(inside), bool)
    first[0], first[1:] = inside[0], begins
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def dictionary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words); the words are given by their places in data, ascending and disjoint.
    inside: the mask of bytes that belong to a word, if it is at hand."""
    if len(starts) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    if inside is None:
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = packed.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary())


def spread(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of lengths, one after the other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one aggregate over the text column."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
