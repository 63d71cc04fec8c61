"""What the operators share: reading tables, walking Arrow batches in bounded pieces, numpy string hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..session import checkpointed, shared_folder

__all__ = ["checkpointed", "shared_folder"]

#: Bytes of text that a Python worker works on at a time, beyond the Arrow batch itself (one longer text is held alone).
PIECE_BYTES = 4_000_000
_BYTE_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(kept: list[StructField], made: str) -> StructType:
    """A schema of fields of another one, whatever their names, and of new ones as text."""
    return StructType([*kept, *StructType.fromDDL(made).fields])


def strings(column: pa.Array, null: str | None = "") -> list:
    """Python strings of an Arrow string column; bytes that aren't UTF-8 become replacement characters."""
    try:
        out = column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        out = [None if x is None else x.decode("utf-8", "replace") for x in raw]
    return out if null is None else [null if x is None else x for x in out]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts, each of at most `most` bytes or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts (null: None), each of at most `most` bytes or a single row."""
    for batch, _, _ in byte_pieces(batches, text, most):
        yield batch, strings(batch.column(text), None)


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of many ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes that are hashed at a time, or a single longer range.
HASH_BYTES = 1 << 20


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; the ranges are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, side="right")))
        first = int(starts[at])
        out[at:to] = _hash_piece(data[first : int(ends[to - 1])], starts[at:to] - first, ends[at:to] - first)
        at = to
    return out


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    powers = np.full(int(lengths.max()) + 1, BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    bounds = np.append(starts, len(data))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(bounds))
    inside = place < np.repeat(lengths, np.diff(bounds))
    codes = np.zeros(len(data) + 1, np.uint64)
    codes[:-1][inside] = _BYTE_CODES[data[inside]] * powers[place[inside]]
    sums = np.add.reduceat(codes, starts)
    return mix(np.where(lengths > 0, sums, np.uint64(0)) ^ mix(lengths.astype(np.uint64)))


def count_in(held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of held[start:end] are set; the ranges are in order and don't overlap. Takes a byte for each byte of text."""
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(ends > starts)
    if len(some):
        bounds = np.column_stack((starts[some], ends[some])).ravel()
        out[some] = np.add.reduceat(np.append(held, False), bounds, dtype=np.int64)[::2]
    return out
