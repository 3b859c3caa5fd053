"""Helpers that run inside tasks: packed number columns, tokens of a batch, shipping by value."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_value(name: str) -> None:
    """Functions of module ``name`` travel to the workers inside the job, which then need no copy
    of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def release() -> None:
    """Gives freed memory back to the system, so that a worker's next stage starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def aside(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``docs`` with columns that are called like one of ``names`` renamed: underscores are appended
    until the name is free."""
    taken = {c.lower() for c in docs.columns} | set(names)
    for c in docs.columns:
        if c.lower() in names:
            free = c + "_"
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            docs = docs.withColumnRenamed(c, free)
    return docs


def pack(values: np.ndarray) -> bytes:
    """A number column as bytes: equal byte positions side by side, then zstd."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if len(raw) else np.empty(0, dtype)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + size), one run after the other."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.cumsum(sizes) - sizes
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, sizes)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of a batch of texts (runs of anything but bytes 09-0D and 20; A-Z lowered).

    Returns the number of words of each text, the words of all texts as positions in the list of
    distinct words, and that list. A null text has none."""
    # Copied first: lower-casing a slice that starts far into its array garbles bytes.
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    known = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
    if "" in known:  # white space at either end leaves empty pieces
        blank = known.index("")
        keep = at != blank
        sums = np.concatenate(([0], np.cumsum(keep)))
        offsets, at = sums[offsets], at[keep]
        known.pop(blank)
        at = at - (at > blank)
    return np.diff(offsets), at.astype(np.int64), known


def array_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, text: str, most: int = 16 << 20):
    """The batch in runs of rows with about ``most`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // most
    borders = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(borders, borders[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
