"""Rows of the same keys brought together by one shuffle of compressed columns.

A row that is shuffled by itself carries eight bytes for each number and word it holds. Here a task packs the
columns of the rows that go to the same bucket, as small numbers and joined texts, and only such packets are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexweave.functions.batches import bounds, integers, is_set, list_array, list_bounds, text_bytes, texts_of

# Bytes of columns that a task holds before it packs them, and buckets that share a partition.
HELD_BYTES = 32 << 20
BUCKETS_PER_PARTITION = 4
# Texts of fewer kinds than this are packed as their numbers.
KINDS = 255
# Numbers of at most six decimals are packed as whole numbers.
DECIMALS = 1e6
_SMALL = (np.int8, np.int16, np.int32, np.int64)
_DTYPES = tuple(np.dtype(t) for t in (np.uint8, *_SMALL))
_LINE = ord("\n")


def _narrow(values: np.ndarray) -> np.ndarray:
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(t for t in _SMALL if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return values.astype(kind)


def _numbers(values: np.ndarray) -> list[np.ndarray]:
    """As they are or as steps, whichever is smaller."""
    plain, steps = _narrow(values), _narrow(np.diff(values, prepend=np.int64(0)))
    small = steps.itemsize < plain.itemsize
    return [np.array([small], np.uint8), steps if small else plain]


def _decimals(values: np.ndarray) -> list[np.ndarray]:
    """Numbers of few decimals as whole ones, if all of them come back exactly."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.rint(values * DECIMALS)
        exact = np.array_equal(whole / DECIMALS, values) and bool((np.abs(whole) < 1 << 53).all()) and not (np.signbit(values) & (values == 0)).any()
    return [np.array([exact], np.uint8), *(_numbers(whole.astype(np.int64)) if exact else [values.view(np.uint8)])]


def _texts(array: pa.Array) -> list[np.ndarray]:
    coded = array.dictionary_encode() if len(array) > 2 * KINDS else None
    if coded is not None and len(coded.dictionary) <= KINDS:
        return [np.array([2], np.uint8), integers(coded.indices).astype(np.uint8), *_texts(coded.dictionary)]
    data, at = text_bytes(array)
    if (data == _LINE).any():
        return [np.array([0], np.uint8), *_numbers(np.diff(at)), data]
    return [np.array([1], np.uint8), np.insert(data, at[1:], _LINE)]


def _columns(array: pa.Array) -> list[np.ndarray]:
    kind, valid = array.type, is_set(array)
    found = [np.zeros(0, np.uint8) if valid.all() else np.packbits(valid)]
    if pa.types.is_string(kind):
        return found + _texts(array)
    if pa.types.is_integer(kind):
        return found + _numbers(integers(array))
    if pa.types.is_list(kind):
        return found + _numbers(np.diff(list_bounds(array))) + _columns(array.flatten())
    if pa.types.is_struct(kind):
        return found + [part for field in array.flatten() for part in _columns(field)]
    if pa.types.is_float64(kind):
        return found + _decimals(np.asarray(pc.fill_null(array, 0.0), np.float64))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("c", kind)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([array], names=["c"]))
    return [*found, np.frombuffer(sink.getvalue(), np.uint8)]


def _number_values(parts: Iterator[np.ndarray]) -> np.ndarray:
    stepped, values = next(parts), next(parts).astype(np.int64)
    return np.cumsum(values) if stepped[0] else values


def _text_values(parts: Iterator[np.ndarray]) -> pa.Array:
    form = next(parts)[0]
    if form == 2:
        codes = next(parts)
        return _text_values(parts).take(pa.array(codes))
    if form == 0:
        at = bounds(_number_values(parts))
        return texts_of(next(parts), at)
    data = next(parts)
    ends = np.flatnonzero(data == _LINE)
    return texts_of(data[data != _LINE], bounds(np.diff(ends, prepend=-1) - 1))


def _array(kind: pa.DataType, n: int, parts: Iterator[np.ndarray]) -> pa.Array:
    bits = next(parts)
    valid = np.unpackbits(bits, count=n).astype(np.bool_) if len(bits) else np.ones(n, np.bool_)
    if pa.types.is_string(kind):
        values = _text_values(parts)
        return values if valid.all() else values.take(pa.array(np.arange(n), mask=~valid))
    if pa.types.is_integer(kind):
        return pa.array(_number_values(parts), pa.int64(), mask=~valid).cast(kind)
    if pa.types.is_list(kind):
        at = bounds(_number_values(parts))
        return list_array(at, _array(kind.value_type, int(at[-1]), parts), valid).cast(kind)
    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([_array(f.type, n, parts) for f in fields], fields=fields, mask=pa.array(~valid))
    if pa.types.is_float64(kind):
        exact = next(parts)[0]
        return pa.array(_number_values(parts) / DECIMALS if exact else next(parts).view(np.float64), mask=~valid)
    return pa.ipc.open_stream(pa.py_buffer(next(parts))).read_all().column(0).combine_chunks()


def pack(batch: pa.RecordBatch, form: int = 0) -> bytes:
    """The columns of a batch, and a number that tells how they were made."""
    parts = [part for column in batch.columns for part in _columns(column)]
    head = [batch.num_rows, form, len(parts)]
    for part in parts:
        head += [_DTYPES.index(part.dtype), len(part)]
    data = b"".join([np.array(head, np.int64).tobytes(), *(p.tobytes() for p in parts)])
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpack(packet: bytes, schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
    data = pa.Codec("zstd").decompress(packet[8:], int.from_bytes(packet[:8], "little"), asbytes=True)
    n, form, count = np.frombuffer(data, np.int64, 3).tolist()
    head = np.frombuffer(data, np.int64, 2 * count, 24).tolist()
    parts, at = [], 24 + 16 * count
    for kind, size in zip(head[::2], head[1::2], strict=True):
        parts.append(np.frombuffer(data, _DTYPES[kind], size, at))
        at += parts[-1].nbytes
    each = iter(parts)
    return pa.RecordBatch.from_arrays([_array(f.type, n, each) for f in schema], schema=schema), form


@dataclass
class Part:
    """Rows to be gathered; ``shrink`` may give a smaller form of a batch with its number, from which ``grow`` makes it again."""

    rows: DataFrame
    shrink: Callable[[pa.RecordBatch], tuple[pa.RecordBatch, int]] = lambda batch: (batch, 0)
    grow: Callable[[pa.RecordBatch, int], pa.RecordBatch] = lambda batch, form: batch


def _packets(part: Part, number: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shrink = part.shrink

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = integers(table.column("_bucket").combine_chunks())
        order = np.argsort(bucket, kind="stable")
        rows = table.select(schema.names).take(pa.array(order)).cast(schema).combine_chunks()
        bucket = bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        packets = []
        for start, end in zip(starts, np.append(starts, len(bucket))[1:], strict=True):
            (batch,) = rows.slice(start, end - start).to_batches()
            packets.append(pack(*shrink(batch)))
        columns = [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), number), pa.int32()), pa.array(packets, pa.binary())]
        yield from pa.table(columns, names=["bucket", "part", "packet"]).to_batches(max_chunksize=1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD_BYTES:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    return run


def gathered(
    parts: Sequence[Part], keys: Sequence[str], made: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]], schema: StructType
) -> DataFrame:
    """What ``made`` gives for the rows of whole keys, one table for each of the ``parts``; rows of a key meet in one task.

    ``keys`` are columns of all parts, of the same types; rows with the same values of them come in the same call.
    """
    spark = parts[0].rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(partitions * BUCKETS_PER_PARTITION)).cast("int")
    schemas = [to_arrow_schema(part.rows.schema) for part in parts]
    grow = [part.grow for part in parts]
    packets = None
    for number, part in enumerate(parts):
        rows = part.rows.select(bucket.alias("_bucket"), *part.rows.columns)
        own = rows.mapInArrow(_packets(part, number, schemas[number]), "bucket int, part int, packet binary")
        packets = own if packets is None else packets.union(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables(held: list[list[pa.RecordBatch]]) -> list[pa.Table]:
            return [pa.Table.from_batches(own, schema=s).combine_chunks() for own, s in zip(held, schemas, strict=True)]

        current, held = None, []
        for batch in batches:
            for at, number, packet in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "packet")), strict=True):
                if at != current:
                    if held:
                        yield from made(tables(held))
                    current, held = at, [[] for _ in schemas]
                held[number].append(grow[number](*unpack(packet, schemas[number])))
        if held:
            yield from made(tables(held))

    dealt = packets.repartitionById(partitions, F.col("bucket") % F.lit(partitions)).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)
