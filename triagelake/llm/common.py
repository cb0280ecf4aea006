"""Shared helpers: reading, Arrow text buffers as numpy arrays, word bounds and hashes.

Every operator of this subpackage takes and returns DataFrames.  Python code runs on
Arrow batches inside Spark tasks; nothing here gathers rows on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: blank, and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_A = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes
#: Ranges of more bytes are hashed and compared one by one.
_LONG = 64

#: Bytes of text that one round of numpy work takes; bounds a worker's memory.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one in a local run or a test, and only there."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for what outlives a lost one")
    import tempfile

    return tempfile.mkdtemp(prefix="triagelake-scratch-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the folder that the cluster names; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def leading(df: DataFrame, column: str, rest: list[str] | None = None) -> DataFrame:
    """The column under a name that no other has, then the rest (all columns, unless named)."""
    rest = df.columns if rest is None else rest
    name = "_in"
    while name.lower() in {c.lower() for c in rest}:
        name += "_"
    return df.select(F.col(f"`{column}`").alias(name), *[F.col(f"`{c}`") for c in rest])


def text_key(text=None):
    """64-bit hash of a whole text; together with doc_id it names a row's content."""
    return F.xxhash64(F.coalesce(text if text is not None else F.col("text"), F.lit("")))


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """For every position the eight bytes from there as one number, zeros past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), eight bytes a round; XXH64 of the long ones.

    Every byte passes through the mixer after those before it, so no repetitive text makes two contents equal by
    structure, as it does for sums of powers modulo 2**64.
    """
    n = ends - starts
    h = mix(n.astype(np.uint64) + _A)
    view, done = eights(data), 0
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    while len(live):
        left = n[live] - done
        h[live] = mix(h[live] * _A ^ (view[starts[live] + done] & _LOW[np.minimum(left, 8)]))
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(n > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], 7)
    return h


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _A + right)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every width neighbouring values, joined from windows of half the size."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, size = None, 0, h, 1
    while True:
        if width // size % 2:
            out = level if out is None else join_hashes(out[: len(level) - have], level[have:])
            have += size
        if have == width:
            return out[:n]
        level, size = join_hashes(level[:-size], level[size:]), 2 * size


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a are those from b, byte by byte."""
    ok = np.ones(len(a), bool)
    view, done = eights(data), 0
    live = np.flatnonzero((n > 0) & (n <= 4 * _LONG))
    while len(live):
        left = n[live] - done
        same = (view[a[live] + done] ^ view[b[live] + done]) & _LOW[np.minimum(left, 8)] == 0
        ok[live[~same]] = False
        live, done = live[same & (left > 8)], done + 8
    for i in np.flatnonzero(n > 4 * _LONG).tolist():
        ok[i] = np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]])
    return ok


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, back): one range of each content, and for every range the place of its content; the bytes decide."""
    return distinct_runs(data, starts, ends, range_hashes(data, starts, ends))


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As distinct_ranges, for ranges that are equal only if their keys are."""
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    lead, n = first[back], ends - starts
    check = np.flatnonzero(lead != np.arange(len(lead)))
    to = lead[check]
    same = n[check] == n[to]
    same[same] = equal_ranges(data, starts[check[same]], starts[to[same]], n[check[same]])
    if not same.all():  # equal keys of unequal bytes: a group for each further content
        more: dict = {}
        for i in check[~same].tolist():
            back[i] = len(first) + more.setdefault((int(key[i]), data[starts[i] : ends[i]].tobytes()), len(more))
        new = np.full(len(more), len(starts))
        late = check[~same]
        np.minimum.at(new, back[late] - len(first), late)
        first = np.concatenate([first, new])
    return first, back


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Cuts a string column into (first row, last row + 1, bytes, offsets) of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
        offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of all rows of a block; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    first = offs[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count of them."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(jump - starts, counts)


