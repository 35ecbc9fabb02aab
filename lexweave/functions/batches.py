"""Texts and lists of Arrow batches as numpy arrays, and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.StringArray:
    at = pa.py_buffer(offsets.astype(np.int32))
    return pa.StringArray.from_buffers(len(offsets) - 1, at, pa.py_buffer(np.ascontiguousarray(data)))


def bounds(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes begin, and where the last one ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def list_bounds(lists: pa.Array) -> np.ndarray:
    """Bounds of the lists within ``lists.flatten()``; nulls are empty."""
    return bounds(np.asarray(pc.fill_null(lists.value_lengths(), 0), np.int64))


def list_array(offsets: np.ndarray, values: pa.Array, valid: np.ndarray | None = None) -> pa.ListArray:
    mask = None if valid is None or valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def is_set(array: pa.Array) -> np.ndarray:
    return array.is_valid().to_numpy(zero_copy_only=False)


def integers(array: pa.Array, missing: int = 0) -> np.ndarray:
    return np.asarray(pc.fill_null(array.cast(pa.int64()), missing), np.int64)


def optional(values: np.ndarray, there: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """``values``, null where not ``there``."""
    return pa.array(values, kind, mask=~there)


def equals(array: pa.Array, *texts: str) -> np.ndarray:
    """Whether each text is one of ``texts``; not where it is null."""
    return pc.is_in(array, value_set=pa.array(texts, pa.string())).to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of every range, one range after the other."""
    first = bounds(sizes)
    return np.arange(first[-1]) + np.repeat(starts - first[:-1], sizes)


def changes(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row has other keys than the row before; the first one always."""
    new = np.zeros(batch.num_rows, np.bool_)
    new[:1] = True
    for key in keys:
        column = batch.column(key)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = np.asarray(column.dictionary_encode(null_encoding="encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches again, such that no table ends within the rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(changes(batch, keys))
        own = batch.select(list(keys)).slice(0, 1)
        if held and held[-1].select(list(keys)).slice(held[-1].num_rows - 1).equals(own):
            new = new[1:]
        if not len(new):
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, new[-1])]
        if sum(part.num_rows for part in ready):
            yield pa.Table.from_batches(ready).combine_chunks()
        held = [batch.slice(new[-1])]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
