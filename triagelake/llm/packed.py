"""Packed rows: many small records that travel as one binary value for each (source block, bucket).

Window and anchor records are a few bytes each; as single rows they would cost several times their size.
A block of text sends one row to each bucket, and the bucket's task answers with one row to each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes for each bucket, which bounds what a bucket's task holds, however large the input.
BUCKET_BYTES = 7 << 19


#: More would not fit the 32 bits that choose a bucket.
MAX_BUCKETS = 1 << 24


def bucket_count(df: DataFrame, column: str = "text") -> int:
    """Buckets in proportion to the bytes of the frame's texts, counted in one pass, so any derived frame will do."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return min(MAX_BUCKETS, max(64, int(size) // BUCKET_BYTES))


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, all first bytes first: zero high bytes then compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, from its high half, so that the low half stays as the record."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cut(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a sorted bucket column: the buckets, and where each begins and ends."""
    if not len(bucket):
        z = np.zeros(0, np.int64)
        return z, z, z
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[begin].astype(np.int64), begin, np.append(begin[1:], len(bucket))


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def in_order(rows: DataFrame) -> DataFrame:
    """The rows, each partition in the order of d, t: blocks packed from them are the same whenever a task runs again.

    A shuffle delivers rows in any order, and answers name positions inside a block.
    """
    return rows.sortWithinPartitions("d", "t")
