"""Suffix-array dedup of byte strings: every byte under a 100-byte string that starts earlier goes.

Each window of 100 bytes has one anchor, the leftmost of its 32-byte grams with the smallest hash.  Equal windows
have equal anchors at equal offsets, so anchors split the search over buckets and nothing is missed:

1. blocks of text send their distinct anchor hashes to buckets, which answer which stand twice or more;
2. documents with such anchors send, once a block, each distinct segment (the windows of one anchor) to buckets;
3. a bucket builds the suffix arrays of the segments of each anchor (``lyndon_sa``: groups of suffixes by Lyndon
   prefix in descending order with previous-smaller pointers, then each group's order without renaming); windows
   next to each other in a suffix array that share 100 bytes are one class, and a class knows its smallest doc_id;
4. the block drops the windows whose class stands in a smaller doc_id, or earlier in the same document.

Anchors in more than HOT_BLOCKS blocks are dealt out by the 93 bytes or more that all windows of eight adjacent
offsets share, instead of by the anchor; within a task an anchor of more than MAX_SEGMENTS distinct segments is
split likewise, by halves of its offsets.  At one offset the shared bytes are the window itself, so this ends.
Equal segments of a block travel once, so a passage in a third of all documents costs a bucket one entry a block.

Edge cases: a null or empty text has no bytes; fewer than 100 bytes lose nothing; a null doc_id sorts after all
others; rows that share a doc_id do not count as smaller than each other; repeated rows each come out; further
columns are ignored whatever their names; empty in, empty out.  Removal may cut a character; the kept text is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import blocks, distinct_runs, eights, equal_ranges, join_hashes, mix, ragged, range_hashes, table, text_key
from triagelake.llm.lyndon_sa import suffix_arrays
from triagelake.llm.packed import binary, bucket_count, bucket_of, cut, in_order, planes, unplanes

LENGTH, GRAM = 100, 32
#: Bytes of text whose anchors and segments are packed together.
PACK_BYTES = 4 << 20
SLICE = 1 << 20
HOT_BLOCKS, HOT_OFFSETS, MAX_SEGMENTS = 64, 8, 32
#: Symbols whose suffix arrays are built together.
BATCH_SYMBOLS = 1 << 19
NO_ID = 2**63 - 1


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return v if have == width else np.minimum(v[: len(v) - width + have], v[width - have :])


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, gram position, gram hash) of each run of windows with one anchor, in text order."""
    out = []
    grams = length - GRAM + 1  # a window
    for x in range(0, max(len(data) - length + 1, 0), SLICE):
        part = data[x : x + SLICE + length - 1]
        at = np.arange(len(part) - GRAM + 1)
        g = np.ascontiguousarray(eights(part)[:-1])
        g = join_hashes(g[:-8], g[8:])
        g = join_hashes(g[:-16], g[16:])[: len(at)]
        a = (_smallest((g & ~np.uint64((1 << 21) - 1)) | at.astype(np.uint64), grams) & np.uint64((1 << 21) - 1)).astype(np.int64)
        # windows must lie in one row: those within length - 1 bytes before a row's end, but the row's own, do not
        inside = np.ones(len(a), bool)
        ends = offs[1:] - x
        for e in ends[(ends > 0) & (ends < len(part))].tolist():
            inside[max(0, e - length + 1) : e] = False
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.append(new | ~inside, True))
        count = stop[np.searchsorted(stop, first, "right")] - first
        out.append((first + x, count, a[first] + x, g[a[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _split(start: np.ndarray, count: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cuts runs of windows at multiples of size of their offset: (run, first window in it, windows, offset)."""
    high, low = off // size, (off - count + 1) // size
    pieces = high - low + 1
    run = np.repeat(np.arange(len(start)), pieces)
    band = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    top = np.minimum(off[run], band * size + size - 1)
    bottom = np.maximum(off[run] - count[run] + 1, band * size)
    return run, off[run] - top, top - bottom + 1, top


def _core(data: np.ndarray, gram: np.ndarray, off: np.ndarray, size: int, length: int) -> np.ndarray:
    """Hash of the bytes that all windows of the offsets' band share, for windows around grams at gram."""
    low = off // size * size
    high = np.minimum(low + size - 1, length - GRAM)
    return mix(range_hashes(data, gram - low, gram - high + length) + low.astype(np.uint64))


def _distinct(data: np.ndarray, start: np.ndarray, count: np.ndarray, off: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One run of each (key, offset, bytes), and every run's place among them; equal bytes, not only equal hashes."""
    end = start + count + length - 1
    return distinct_runs(data, start, end, mix(key ^ mix(range_hashes(data, start, end) + off.astype(np.uint64))))


def window_classes(data: np.ndarray, start: np.ndarray, count: np.ndarray, off: np.ndarray, key: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of every run, run after run, the number of the first window equal to it.

    start, count and off: first byte, windows and offset from the gram of each run; only runs of equal key are compared.
    """
    base = np.cumsum(count) - count
    cls = np.arange(int(count.sum()))
    todo = [(start, count, off, base, key, 1 << (length - GRAM).bit_length())]
    twins: list[tuple] = []
    while todo:
        start, count, off, base, key, size = todo.pop()
        pick, back = _distinct(data, start, count, off, key, length)
        twin = np.flatnonzero(pick[back] != np.arange(len(back)))
        twins.append((base[twin], base[pick[back[twin]]], count[twin]))
        pick = pick[np.argsort(key[pick], kind="stable")]
        start, count, off, base, key = start[pick], count[pick], off[pick], base[pick], key[pick]
        _, x, y = cut(key)
        width = y - x
        large = np.repeat(width > MAX_SEGMENTS, width)
        if large.any():
            s, n, o, b = start[large], count[large], off[large], base[large]
            half = size // 2
            run, skip, n2, o2 = _split(s, n, o, half)
            s2 = s[run] + skip
            todo.append((s2, n2, o2, b[run] + skip, mix(key[large][run] + _core(data, s2 + o2, o2, half, length)), half))
        some = np.flatnonzero((width > 1) & (width <= MAX_SEGMENTS))
        size_of = np.add.reduceat(count + length, x)[some] if len(x) else np.zeros(0, np.int64)
        some, size_of = some[np.argsort(size_of)], np.sort(size_of)
        batch = np.cumsum(size_of) // BATCH_SYMBOLS
        for k, p, q in zip(*cut(batch)):
            of = some[p:q]
            _order(data, start, count, base, ragged(x[of], width[of]), width[of], cls, length)
    for mine, first, n in reversed(twins):  # a twin's representative may itself have been resolved deeper
        to = ragged(mine, n)
        cls[to] = cls[ragged(first, n)]
    # numbers of first windows in run order
    low = np.full(len(cls), len(cls))
    np.minimum.at(low, cls, np.arange(len(cls)))
    return low[cls]


def _order(data, start, count, base, runs, width, cls, length) -> None:
    """Suffix arrays of the groups of runs (width of them each); sets the classes of their windows."""
    n = count[runs] + length  # bytes of a run, and a separator
    to = np.cumsum(n)
    sym = np.empty(int(to[-1]), np.int64)
    body = np.ones(len(sym), bool)
    body[to - 1] = False
    sym[body] = data[ragged(start[runs], n - 1)].astype(np.int64) + 2
    sym[~body] = 1
    group_end = to[np.cumsum(width) - 1]
    sym[group_end - 1] = 0
    begin = np.concatenate([[0], group_end])
    sa = suffix_arrays(sym, begin)
    window = np.full(len(sym), -1)
    window[ragged(to - n, count[runs])] = ragged(base[runs], count[runs])
    sa = sa[window[sa] >= 0]
    # neighbours of one group with a common prefix of length or more are one class
    group = np.searchsorted(begin, sa, "right")
    byte = np.zeros(len(sym), np.int64)
    byte[ragged(to - n, n - 1)] = ragged(start[runs], n - 1)
    text = byte[sa]
    new = np.ones(len(sa), bool)
    new[1:] = (group[1:] != group[:-1]) | ~equal_ranges(data, text[1:], text[:-1], np.full(max(len(sa) - 1, 0), length))
    cls[window[sa]] = window[sa][np.flatnonzero(new)[np.cumsum(new) - 1]]


_PACKED = "key bigint, name bigint, p binary, q binary, r binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("p", pa.binary()), ("q", pa.binary()), ("r", pa.binary())])


def _rows(keys: list[int], names: list[int], p: list, q: list, r: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), binary(p), binary(q), binary(r)], schema=_SCHEMA)


def _table(*columns) -> pa.Table:
    return pa.Table.from_batches([_rows(*columns)])


def _place(part: pa.RecordBatch, edge: np.ndarray) -> bytes:
    """doc_ids, text keys and each row's first entry, as one value."""
    return b"".join(np.asarray(c, np.int64).tobytes() for c in (part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), edge))


def _placed(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.int64)
    n = (len(a) - 1) // 3
    return a[:n], a[n : 2 * n], a[2 * n :]


def _probe(buckets: int, length: int):
    """Blocks to their distinct anchor hashes by bucket, and a row with the block's places (key: below zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0), PACK_BYTES):
                _, _, gram, h = anchors(data, offs, length)
                if not len(gram):
                    continue
                name += 1
                row = np.searchsorted(offs, gram, "right") - 1
                values, back, n = np.unique(h, return_inverse=True, return_counts=True)
                keys, p, q, r = [], [], [], []
                for k, x, y in zip(*cut(bucket_of(values, buckets))):  # ascending, as the values are
                    keys.append(int(k))
                    p.append(planes((values[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
                    q.append(np.packbits(n[x:y] > 1).tobytes())
                    r.append(np.int64(x).tobytes())
                edge = np.searchsorted(row, np.arange(b - a + 1))
                yield _rows([*keys, -1 - name], [name] * (len(keys) + 1), [*p, planes(back.astype(np.uint32))], [*q, planes((gram - offs[row]).astype(np.uint32))], [*r, _place(batch.slice(a, b - a), edge)])

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """One bucket: which of a block's hashes stand twice or more, and which in many blocks. Places pass through."""
    if t.column("key")[0].as_py() < 0:
        return t.cast(_SCHEMA)
    names, p, q, r = (t.column(c).to_pylist() for c in ("name", "p", "q", "r"))
    low = [unplanes(x, np.uint32) for x in p]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)) for x, v in zip(q, low)]).astype(bool)
    _, back, n = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    twice = n > 1
    twice[back[many]] = True
    flag, hot, at, out = twice[back], (n > HOT_BLOCKS)[back], 0, []
    for x, base in zip(low, r):
        mine = np.flatnonzero(flag[at : at + len(x)])
        out.append(planes((((mine + np.frombuffer(base, np.int64)[0]) << 1) | hot[at : at + len(x)][mine]).astype(np.uint32)))
        at += len(x)
    keep = [k for k, x in enumerate(out) if x]
    return _table([-1 - names[k] for k in keep], [names[k] for k in keep], [out[k] for k in keep], [None] * len(keep), [None] * len(keep))


def _starts(t: pa.Table) -> pa.Table:
    """One block: per document the positions of its repeated anchors, doubled, plus one where hot."""
    ids, keys, starts = [], [], []
    rows = t.to_pylist()
    own = [x for x in rows if x["q"] is not None]
    if own and len(rows) > 1:
        back, at = unplanes(own[0]["p"], np.uint32), unplanes(own[0]["q"], np.uint32)
        doc, key, edge = _placed(own[0]["r"])
        met = np.concatenate([unplanes(x["p"], np.uint32) for x in rows if x["q"] is None])
        kind = np.zeros(int(max(back.max(), (met >> 1).max())) + 1, np.uint8)
        kind[met >> 1] = 1 + (met & 1)
        mine = kind[back]
        for i in np.flatnonzero(np.diff(edge)).tolist():
            k = mine[edge[i] : edge[i + 1]]
            hit = k > 0
            if hit.any():
                ids.append(int(doc[i]))
                keys.append(int(key[i]))
                starts.append(planes(np.unique((at[edge[i] : edge[i + 1]][hit] << 1) | (k[hit] - 1))))
    return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), binary(starts)], names=["d", "t", "starts"])


def _segments(buckets: int, length: int):
    """Documents with repeated anchors to a block's distinct segments by bucket, and a row with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(0), PACK_BYTES):
                part = batch.slice(a, b - a)
                start, count, gram, key = anchors(data, offs, length)
                met = [unplanes(x, np.uint32) for x in part.column(3).to_pylist()]
                kind = np.zeros(len(data) + 1, np.uint8)
                for o, x in zip(offs.tolist(), met):
                    kind[o + (x >> 1).astype(np.int64)] = 1 + (x & 1)
                hit = np.flatnonzero(kind[gram])
                if not len(hit):
                    continue
                start, count, gram, key = start[hit], count[hit], gram[hit], key[hit]
                hot = kind[gram] == 2
                run_, skip, n, off = _split(start[hot], count[hot], (gram - start)[hot], HOT_OFFSETS)
                core = mix(key[hot][run_] + _core(data, gram[hot][run_], off, HOT_OFFSETS, length))
                off = np.concatenate([(gram - start)[~hot], off])
                start = np.concatenate([start[~hot], start[hot][run_] + skip])
                count = np.concatenate([count[~hot], n])
                key = np.concatenate([mix(key[~hot]), core])
                bucket = bucket_of(key, buckets)
                pick, back = _distinct(data, start, count, off, key, length)
                order = np.argsort(bucket[pick], kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                pick, back = pick[order], rank[back]
                doc = part.column(1).to_numpy(zero_copy_only=False)
                row = np.searchsorted(offs, start, "right") - 1
                least = np.full(len(pick), NO_ID)
                np.minimum.at(least, back, doc[row])
                name += 1
                keys, p, q, r = [], [], [], []
                for k, x, y in zip(*cut(bucket[pick])):
                    of = pick[x:y]
                    keys.append(int(k))
                    p.append(np.int64(x).tobytes() + planes(key[of]) + count[of].astype(np.uint8).tobytes() + off[of].astype(np.uint8).tobytes())
                    q.append(planes(least[x:y]))
                    r.append(data[ragged(start[of], count[of] + length - 1)].tobytes())
                by_row = np.argsort(row, kind="stable")
                place = planes(((start - offs[row]) << 8 | count)[by_row])
                edge = np.searchsorted(row[by_row], np.arange(b - a + 1))
                yield _rows([*keys, -1 - name], [name] * (len(keys) + 1), [*p, planes(back[by_row].astype(np.uint32))], [*q, place], [*r, _place(part, edge)])

    return run


def _classes(length: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket: runs of window classes (segment, first window, class, smallest doc_id) for each block."""
        bucket = t.column("key")[0].as_py()
        if bucket < 0:
            return t.cast(_SCHEMA)
        names, p, q, r = (t.column(c).to_pylist() for c in ("name", "p", "q", "r"))
        n = [(len(x) - 8) // 10 for x in p]
        key = np.concatenate([unplanes(x[8 : 8 + 8 * k], np.uint64) for x, k in zip(p, n)])
        count = np.concatenate([np.frombuffer(x, np.uint8, k, 8 + 8 * k) for x, k in zip(p, n)]).astype(np.int64)
        off = np.concatenate([np.frombuffer(x, np.uint8, k, 8 + 9 * k) for x, k in zip(p, n)]).astype(np.int64)
        doc = np.concatenate([unplanes(x, np.int64) for x in q])
        data = np.frombuffer(b"".join(r), np.uint8)
        size = count + length - 1
        cls = window_classes(data, np.cumsum(size) - size, count, off, key, length)
        seg = np.repeat(np.arange(len(count)), count)
        best = np.full(len(cls), NO_ID)
        np.minimum.at(best, cls, doc[seg])
        best = best[cls]
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (cls[1:] != cls[:-1] + 1) | (best[1:] != best[:-1])])
        at = np.flatnonzero(new)
        first = np.cumsum(count) - count
        block = np.repeat(np.arange(len(n)), n)
        base = np.array([np.frombuffer(x, np.int64, 1)[0] for x in p]) - (np.cumsum(n) - n)
        place = (seg[at] + base[block[seg[at]]]) << 8 | (at - first[seg[at]])
        out_p = []
        edges = np.searchsorted(block[seg[at]], np.arange(len(n) + 1))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out_p.append(planes(place[x:y]) + planes((np.int64(bucket) << 32) + cls[at[x:y]]) + planes(best[at[x:y]]))
        return _table([-1 - x for x in names], names, out_p, [None] * len(names), [None] * len(names))

    return run


def _spans(length: int):
    def run(t: pa.Table) -> pa.Table:
        """One block: per document the maximal runs of removed bytes, as (first, last + 1) pairs."""
        ids, keys, spans = [], [], []
        rows = t.to_pylist()
        own = [x for x in rows if x["q"] is not None]
        if own and len(rows) > 1:
            seg = unplanes(own[0]["p"], np.uint32).astype(np.int64)
            place = unplanes(own[0]["q"], np.int64)
            doc, key, edge = _placed(own[0]["r"])
            start, count = place >> 8, place & 255
            row = np.repeat(np.arange(len(doc)), np.diff(edge))
            got = [np.frombuffer(x["p"], np.uint8) for x in rows if x["q"] is None]
            at, cls, best = (np.concatenate([unplanes(np.ascontiguousarray(g[k * (len(g) // 3) : (k + 1) * (len(g) // 3)]).tobytes(), np.int64) for g in got]) for k in range(3))
            order = np.argsort(at)
            at, cls, best = at[order], cls[order], best[order]
            # runs of classes for each occurrence of a segment
            lo, hi = np.searchsorted(at, seg << 8), np.searchsorted(at, (seg << 8) + 255, "right")
            each = ragged(lo, hi - lo)
            occ = np.repeat(np.arange(len(seg)), hi - lo)
            skip = at[each] & 255
            last = np.append(occ[1:] != occ[:-1], True)
            stop = np.where(last, count[occ], np.append(skip[1:], 0))
            s, n, r = start[occ] + skip, stop - skip, row[occ]
            far = best[each] < doc[r]
            # the smallest doc_id's own windows: all but the first of each class in the row
            near = np.flatnonzero(~far)
            w_row, w_at, w_cls = np.repeat(r[near], n[near]), ragged(s[near], n[near]), ragged(cls[each][near], n[near])
            order = np.lexsort((w_at, w_cls, w_row))
            again = order[1:][(w_row[order[1:]] == w_row[order[:-1]]) & (w_cls[order[1:]] == w_cls[order[:-1]])]
            begin = np.concatenate([r[far] << 32 | s[far], w_row[again] << 32 | w_at[again]])
            end = begin + np.concatenate([n[far], np.ones(len(again), np.int64)]) + length - 1
            order = np.argsort(begin)
            begin, end = begin[order], np.maximum.accumulate(end[order])
            if len(begin):
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                x, y = begin[new], end[np.append(new[1:], len(end)) - 1]
                for d, i, j in zip(*cut(x >> 32)):
                    ids.append(int(doc[d]))
                    keys.append(int(key[d]))
                    spans.append((np.stack([x[i:j], y[i:j]], axis=1) - (d << 32)).tobytes())
        return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), binary(spans)], names=["d", "t", "spans"])

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The documents keyed by d, t (doc_id, text hash), and (d, t, spans) of those that lose bytes."""
    n = bucket_count(docs)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), text_key().alias("t"))
    met = own.mapInArrow(_probe(n, length), _PACKED).groupBy("key").applyInArrow(_repeated, _PACKED)
    starts = met.groupBy("key").applyInArrow(_starts, "d bigint, t bigint, starts binary").groupBy("d", "t").agg(F.first("starts").alias("starts"))
    found = in_order(own.join(starts.hint("shuffle_hash"), ["d", "t"]).select("text", "d", "t", "starts"))
    runs = found.mapInArrow(_segments(n, length), _PACKED).groupBy("key").applyInArrow(_classes(length), _PACKED)
    spans = runs.groupBy("key").applyInArrow(_spans(length), "d bigint, t bigint, spans binary").groupBy("d", "t").agg(F.first("spans").alias("spans"))
    return own, spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start, end in bytes) and kept, the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, gone, found, kept = [], [], [], []
                for text, raw in zip(part.column(0).cast(pa.large_binary()).to_pylist(), part.column(2).to_pylist()):
                    cuts = np.frombuffer(raw or b"", np.int64).reshape(-1, 2).tolist()
                    edges = [0, *[x for c in cuts for x in c], len(text)]
                    rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                    n.append(len(text))
                    gone.append(len(text) - len(rest))
                    found.append([{"start": x, "end": y} for x, y in cuts])
                    kept.append(rest)
                shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, shape), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    own, spans = removed_spans(docs, length)
    both = own.join(spans.hint("shuffle_hash"), ["d", "t"], "left").select("text", F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "spans")
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
