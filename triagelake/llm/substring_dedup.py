"""Substring dedup with fixed-block anchors.

Every document's non-overlapping blocks of 25 words are indexed; every rolling window of 25 words probes the
index.  Each window of 50 words holds a whole block of whichever document it is read in, so no repeat is missed.
A hit extends to all 50-word windows around it, whose hashes decide: a word goes if a window over it also starts
in a document with a smaller doc_id.  Unions of such windows are the maximal exact repeats.

Records travel packed, one row for each (block of text, bucket), and a hash that repeats inside a block of text
is not sent at all, as it is a hit anyway; so a passage in a third of all documents costs its bucket one entry a
block of text.  No pairs of documents are formed.

Edge cases: a null or empty text has no words; fewer than 50 words lose nothing; a null doc_id sorts after all
others; rows that share a doc_id do not count as smaller than each other; repeated rows each come out; further
columns are carried whatever their names; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, ragged, range_hashes, table, text_key, window_hashes, word_bounds
from triagelake.llm.packed import binary, bucket_count, bucket_of, cut, in_order, planes, unplanes

WINDOW, BLOCK = 50, 25
#: Bytes of text whose windows are packed together.
PACK_BYTES = 6 << 20
NO_ID = 2**63 - 1


def _word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a large block, made in smaller steps, and where each row's words begin."""
    hashes, counts = [], np.zeros(len(offs), np.int64)
    col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
    for a, b, d, o in blocks(col):
        s, e, row = word_bounds(d, o)
        hashes.append(range_hashes(d, s, e))
        counts[a + 1 : b + 1] = np.bincount(row, minlength=b - a)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def _windows(h: np.ndarray, first: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of all windows of size words within rows of at least least words."""
    n = np.diff(first)
    at = ragged(first[:-1], np.where(n >= least, n - size + 1, 0))
    return at, window_hashes(h, size)[at]


def _probe(buckets: int, window: int, block: int):
    """Documents to packed probes and index entries (key: bucket), and a row of each block's documents (key: -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0), PACK_BYTES):
                h, first = _word_hashes(data, offs)
                at, w = _windows(h, first, block, window)
                if not len(w):
                    continue
                name += 1
                order = np.argsort(w)
                s = w[order]
                same = np.zeros(len(s) + 1, bool)
                same[1:-1] = s[1:] == s[:-1]
                many = np.zeros(len(s), bool)
                many[order] = same[1:] | same[:-1]
                # probes: what is single here, by bucket and position; index entries: the aligned ones, once each
                bucket = bucket_of(w, buckets)
                row = np.searchsorted(first, at, "right") - 1
                aligned = (at - first[row]) % block == 0
                single = np.flatnonzero(~many)
                single = single[np.argsort(bucket[single], kind="stable")]
                head = order[~same[:-1]]  # one of each hash
                strong = np.zeros(len(w), bool)
                any_aligned = np.zeros(len(w), bool)
                group = np.cumsum(~same[:-1]) - 1
                hit = np.zeros(len(head), bool)
                hit[group[aligned[order]]] = True
                any_aligned[head[hit]] = True
                strong[head] = many[head]
                index = np.flatnonzero(any_aligned)
                index = index[np.argsort(bucket[index], kind="stable")]
                out: dict[int, list] = {}
                for k, x, y in zip(*cut(bucket[single])):
                    of = single[x:y]
                    out.setdefault(int(k), [None] * 3)[0] = planes((w[of] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                    out[int(k)][1] = planes(np.diff(of, prepend=0).astype(np.uint32))
                for k, x, y in zip(*cut(bucket[index])):
                    of = index[x:y]
                    out.setdefault(int(k), [None] * 3)[2] = planes((w[of] & np.uint64(0xFFFFFFFF)).astype(np.uint64) << np.uint64(1) | strong[of])
                keys = list(out)
                yield _rows([*keys, -1 - name], name, [*[out[k][0] for k in keys], planes(at.astype(np.uint32))], [*[out[k][1] for k in keys], np.flatnonzero(many).astype(np.uint32).tobytes()],
                            [*[out[k][2] for k in keys], batch.slice(a, b - a).column(1).to_numpy(zero_copy_only=False).tobytes() + batch.slice(a, b - a).column(2).to_numpy(zero_copy_only=False).tobytes() + first.tobytes()])

    return run


def _rows(keys: list[int], name: int, p: list, q: list, r: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([name] * len(keys), pa.int64()), binary(p), binary(q), binary(r)], names=["key", "name", "p", "q", "r"])


_PACKED = "key bigint, name bigint, p binary, q binary, r binary"


def _answer(t: pa.Table) -> pa.Table:
    """One bucket: which probes meet an index entry of another place. Rows of documents pass through."""
    key = t.column("key")[0].as_py()
    if key < 0:
        return t.cast(_schema())
    names, p, q, r = (t.column(c).to_pylist() for c in ("name", "p", "q", "r"))
    probes = [unplanes(x, np.uint32) if x else np.zeros(0, np.uint32) for x in p]
    entries = np.concatenate([unplanes(x, np.uint64) for x in r if x] or [np.zeros(0, np.uint64)])
    strong = np.unique(entries[entries & np.uint64(1) > 0] >> np.uint64(1)).astype(np.uint32)
    index = np.unique(entries >> np.uint64(1)).astype(np.uint32)
    flat = np.concatenate(probes) if probes else np.zeros(0, np.uint32)
    hit = _in(flat, index)
    met = flat[hit]
    values, count = np.unique(met, return_counts=True)
    shared = np.union1d(values[count > 1], strong) if len(strong) else values[count > 1]
    hit[hit] = _in(met, shared)
    out_name, out_p, at = [], [], 0
    for n, x, places in zip(names, probes, q):
        mine = hit[at : at + len(x)]
        at += len(x)
        if mine.any():
            out_name.append(n)
            out_p.append(np.cumsum(unplanes(places, np.uint32).astype(np.int64))[mine].astype(np.uint32).tobytes())
    k = len(out_name)
    return pa.table([pa.array([-1 - n for n in out_name], pa.int64()), pa.array(out_name, pa.int64()), binary(out_p), binary([None] * k), binary([None] * k)], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("name", pa.int64()), ("p", pa.binary()), ("q", pa.binary()), ("r", pa.binary())])


def _in(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def _starts(t: pa.Table) -> pa.Table:
    """One block of text: per document the start words of its hits."""
    ids, keys, starts = [], [], []
    own = [x for x in t.to_pylist() if x["q"] is not None]
    if own:
        at = unplanes(own[0]["p"], np.uint32).astype(np.int64)
        hits = [np.frombuffer(own[0]["q"], np.uint32)] + [np.frombuffer(x["p"], np.uint32) for x in t.select(["p", "q"]).to_pylist() if x["q"] is None]
        raw = np.frombuffer(own[0]["r"], np.int64)
        n = (len(raw) - 1) // 3
        doc, key, first = raw[:n], raw[n : 2 * n], raw[2 * n :]
        place = np.sort(at[np.concatenate(hits)])
        row = np.searchsorted(first, place, "right") - 1
        for d, x, y in zip(*cut(row)):
            ids.append(int(doc[d]))
            keys.append(int(key[d]))
            starts.append((place[x:y] - first[d]).astype(np.uint32).tobytes())
    return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), binary(starts)], names=["d", "t", "starts"])


def _extend(buckets: int, window: int, block: int):
    """Documents with hits to packed 50-word windows: hash and smallest doc_id here; places go with the block's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0), PACK_BYTES):
                part = batch.slice(a, b - a)
                h, first = _word_hashes(data, offs)
                doc, key = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                rows, places = [], []
                for i, s in enumerate(part.column(3).to_pylist()):
                    s = np.frombuffer(s, np.uint32).astype(np.int64)
                    n = int(first[i + 1] - first[i]) - window + 1
                    mark = np.zeros(n + block + 2, np.int32)
                    np.add.at(mark, np.maximum(s - (window - block), 0), 1)
                    np.add.at(mark, np.minimum(s + 1, n), -1)
                    place = np.flatnonzero(np.cumsum(mark)[:n] > 0)
                    rows.append(np.full(len(place), i))
                    places.append(place)
                row, place = np.concatenate(rows), np.concatenate(places)
                if not len(row):
                    continue
                name += 1
                w = window_hashes(h, window)[first[row] + place]
                values, back = np.unique(w, return_inverse=True)
                least = np.full(len(values), NO_ID)
                np.minimum.at(least, back, doc[row])
                known = doc[row] > least[back]  # a smaller doc_id right here
                bucket = bucket_of(values, buckets)  # ascending, as the values are
                keys, p, q = [], [], []
                for k, x, y in zip(*cut(bucket)):
                    keys.append(int(k))
                    p.append(planes(values[x:y]))
                    q.append(planes(least[x:y]))
                low = planes(np.where(known, np.uint32(0xFFFFFFFF), back.astype(np.uint32)).astype(np.uint32))
                yield _rows([*keys, -1 - name], name, [*p, low], [*q, planes(place.astype(np.uint32))],
                            [*[np.int64(x).tobytes() for x in cut(bucket)[1]], doc.tobytes() + key.tobytes() + np.searchsorted(row, np.arange(len(doc) + 1)).astype(np.int64).tobytes()])

    return run


def _smaller(t: pa.Table) -> pa.Table:
    """One bucket of windows: which block's windows also stand in a document with a smaller doc_id."""
    if t.column("key")[0].as_py() < 0:
        return t.cast(_schema())
    names, p, q, r = (t.column(c).to_pylist() for c in ("name", "p", "q", "r"))
    values, least = [unplanes(x, np.uint64) for x in p], [unplanes(x, np.int64) for x in q]
    flat, low = np.concatenate(values), np.concatenate(least)
    _, back = np.unique(flat, return_inverse=True)
    best = np.full(int(back.max()) + 1, NO_ID)
    np.minimum.at(best, back, low)
    gone = low > best[back]
    out_name, out_p, at = [], [], 0
    for n, x, base in zip(names, values, r):
        mine = np.flatnonzero(gone[at : at + len(x)])
        at += len(x)
        if len(mine):
            out_name.append(n)
            out_p.append((mine + np.frombuffer(base, np.int64)[0]).astype(np.uint32).tobytes())
    k = len(out_name)
    return pa.table([pa.array([-1 - n for n in out_name], pa.int64()), pa.array(out_name, pa.int64()), binary(out_p), binary([None] * k), binary([None] * k)], schema=_schema())


def _spans(window: int):
    def run(t: pa.Table) -> pa.Table:
        """One block: per document the maximal runs of removed words, as (first, last + 1) pairs."""
        ids, keys, spans = [], [], []
        rows = t.to_pylist()
        own = [x for x in rows if x["q"] is not None]
        if own:
            back, place = unplanes(own[0]["p"], np.uint32), unplanes(own[0]["q"], np.uint32).astype(np.int64)
            raw = np.frombuffer(own[0]["r"], np.int64)
            n = (len(raw) - 1) // 3
            doc, key, edge = raw[:n], raw[n : 2 * n], raw[2 * n :]
            far = np.concatenate([np.frombuffer(x["p"], np.uint32) for x in rows if x["q"] is None] or [np.zeros(0, np.uint32)])
            gone = (back == 0xFFFFFFFF) | _in(back, np.sort(far))
            for i in np.flatnonzero(np.diff(edge)).tolist():
                s = place[edge[i] : edge[i + 1]][gone[edge[i] : edge[i + 1]]]
                if len(s):
                    ids.append(int(doc[i]))
                    keys.append(int(key[i]))
                    new = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + window]))
                    spans.append(np.stack([s[new], np.append(s[new[1:] - 1], s[-1]) + window], axis=1).astype(np.int64).tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), binary(spans)], names=["d", "t", "spans"])

    return run


def removed_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents keyed by d, t (doc_id, text hash), and (d, t, spans) of those that lose words."""
    block = window // 2
    n = bucket_count(docs)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), text_key().alias("t"))
    hits = own.mapInArrow(_probe(n, window, block), _PACKED).groupBy("key").applyInArrow(_answer, _PACKED)
    starts = hits.groupBy("key").applyInArrow(_starts, "d bigint, t bigint, starts binary").groupBy("d", "t").agg(F.first("starts").alias("starts"))
    found = in_order(own.join(starts.hint("shuffle_hash"), ["d", "t"]).select("text", "d", "t", "starts"))
    far = found.mapInArrow(_extend(n, window, block), _PACKED).groupBy("key").applyInArrow(_smaller, _PACKED)
    spans = far.groupBy("key").applyInArrow(_spans(window), "d bigint, t bigint, spans binary").groupBy("d", "t").agg(F.first("spans").alias("spans"))
    return own, spans


def cut_words(text: bytes, spans: bytes | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by blanks."""
    words = text.split()
    n = len(words)
    for a, b in np.frombuffer(spans or b"", np.int64).reshape(-1, 2)[::-1].tolist():
        del words[a:b]
    return n, n - len(words), b" ".join(words)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays, its words joined by single blanks."""
    return _finish(docs, window, False)


def _finish(docs: DataFrame, window: int, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = [cut_words(t, s) for t, s in zip(part.column(0).cast(pa.large_binary()).to_pylist(), part.column(2).to_pylist())]
                last = [hashlib.sha256(t).hexdigest() if digest else t.decode() for _, _, t in got]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([n for n, _, _ in got], pa.int64()), pa.array([r for _, r, _ in got], pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    own, spans = removed_spans(docs, window)
    both = own.join(spans.hint("shuffle_hash"), ["d", "t"], "left")
    both = both.select("text", F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "spans")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finish(table(spark, sf_dir, "documents").select("doc_id", "text"), WINDOW, True).withColumnRenamed("kept", "kept_sha256")
