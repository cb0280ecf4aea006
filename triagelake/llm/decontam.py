"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, weighted-shingle check.

Words are lower-cased (A-Z) with ASCII punctuation removed; shingles are five words.  A window of an item's number of
words can reach SIMILARITY only if it holds one of the item's few rarest shingles: so many of them that what is left
is too little.  An index of these chooses the windows and the item that each is for, so a phrase that many items share
costs nothing.  The chosen windows' SimHash fingerprints are taken from running sums of bits; by pigeonhole a pair
within RADIUS bits has one of the eight bytes within RADIUS // 8 bits, and those bytes are compared first.  The exact
weighted Jaccard similarity of the two shingle multisets decides.

The items' index is broadcast in slices of at most SLICE_BYTES of item text; a larger benchmark takes one pass
over the documents for each slice.

A document shorter than an item has no window of its size; the whole document is then its one window for the item.

Edge cases: null and empty texts are clean; an item without words matches nothing; an item of fewer words than
a shingle is one shingle of all its words; equal best windows give the earliest; repeated rows count once in
``find_leaks`` and stay or go together in ``remove_leaks``; further columns are carried; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import TO_LOWER, blocks, leading, ragged, range_hashes, table, window_hashes, word_bounds

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 24
SLICE_BYTES = 16 << 20
#: Hits, and pairs of a window and an item, that are held at once.
PAIRS = 1 << 19
_GONE = np.zeros(256, bool)
_GONE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every normalised word."""
    keep = ~_GONE[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    data, offs = TO_LOWER[data[keep]], at[offs]
    starts, ends, row = word_bounds(data, offs)
    return range_hashes(data, starts, ends), row


def _shingles(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the shingles of width words within rows."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[width - 1 :] == row[:n])
    return window_hashes(words, width)[at], at


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash bytes of a multiset of shingle hashes."""
    return np.packbits(_signs(h).sum(axis=0) > 0, bitorder="little")


def _window_prints(h: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
    """SimHash bytes of the m shingles from each of the ascending places, by running sums over each stretch of them."""
    out = np.empty((len(places), 8), np.uint8)
    a = 0
    while a < len(places):
        b = int(np.searchsorted(places, places[a] + 4096))
        gap = np.flatnonzero(np.diff(places[a:b]) > m)
        b = a + int(gap[0]) + 1 if len(gap) else b
        x, y = int(places[a]), int(places[b - 1])
        sums = np.zeros((y - x + m + 1, 64), np.int32)
        np.cumsum(_signs(h[x : y + m]), axis=0, out=sums[1:])
        at = places[a:b] - x
        out[a:b] = np.packbits(sums[at + m] > sums[at], axis=1, bitorder="little")
        a = b
    return out


class Items:
    """The index of a slice of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = ids
        col = pa.array([t or "" for t in texts], pa.large_string())
        self.n_words, self.bags, keys = [], [], []
        for a, b, data, offs in blocks(col):
            words, row = _words(data, offs)
            edge = np.searchsorted(row, np.arange(b - a + 1))
            for k in range(b - a):
                w = words[edge[k] : edge[k + 1]]
                n = len(w)
                h = _shingles(w, np.zeros(n, np.int64), min(WIDTH, n))[0] if n else np.zeros(0, np.uint64)
                self.n_words.append(n)
                self.bags.append(np.unique(h, return_counts=True))
                keys.append(h)
        self.prints = np.stack([fingerprint(h) if len(h) else np.zeros(8, np.uint8) for h in keys]) if keys else np.zeros((0, 8), np.uint8)
        self.sizes = np.array(self.n_words, np.int64)
        held = [bag[0] for bag in self.bags]
        known, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        # shingle width to (rare shingles, ascending; the item of each; whether whole windows need it; filter; its shift)
        self.widths: dict[int, tuple] = {}
        rare: dict[int, list] = {}
        for k, (h, weight) in enumerate(self.bags):
            if n := self.n_words[k]:
                order = np.lexsort((h, count[np.searchsorted(known, h)]))
                total = int(weight.sum())
                before = np.cumsum(weight[order]) - weight[order]
                # too few shared shingles are left once these are missing: of a text shorter than the item, of a window
                use = order[before <= total - np.ceil(SIMILARITY * total - 1e-9)]
                tight = before[: len(use)] <= total - np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * total - 1e-9)
                rare.setdefault(min(WIDTH, n), []).append((h[use], np.full(len(use), k), tight))
        for width, parts in sorted(rare.items()):
            h, item, tight = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(h, kind="stable")
            h, item, tight = h[order], item[order], tight[order]
            bits = max(16, int(len(h) * 64).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[h >> np.uint64(64 - bits)] = True
            self.widths[width] = (h, item, tight, maybe, np.uint64(64 - bits))

    def similarity(self, k: int, h: np.ndarray) -> float:
        mine, weight = self.bags[k]
        at = np.searchsorted(mine, h)
        at[at == len(mine)] = 0
        hit = at[mine[at] == h]
        both = np.minimum(np.bincount(hit, minlength=len(mine)), weight).sum()
        return float(both / (weight.sum() + len(h) - both))

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of each pair's best window at or over the threshold."""
        words, row = _words(data, offs)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        begin = np.searchsorted(row, np.arange(len(offs)))
        for width, (keys, items, tight, maybe, shift) in self.widths.items():
            h, at = _shingles(words, row, width)
            edge = np.searchsorted(at, begin)  # where each row's shingles begin
            some = np.flatnonzero(maybe[h >> shift])
            lo, hi = np.searchsorted(keys, h[some], "left"), np.searchsorted(keys, h[some], "right")
            some, lo, n = some[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            upto, x = np.cumsum(n), 0
            while x < len(n):
                y = max(x + 1, int(np.searchsorted(upto, upto[x] - n[x] + PAIRS, "right")))
                entry = ragged(lo[x:y], n[x:y])
                pos, item, whole = np.repeat(some[x:y], n[x:y]), items[entry], tight[entry]
                x = y
                doc = row[at[pos]]
                short = np.diff(begin)[doc] < self.sizes[item]
                self._whole(doc[short], item[short], h, edge, begin, found)
                take = ~short & whole
                for s in np.unique(self.sizes[item[take]]).tolist():
                    of = take & (self.sizes[item] == s)
                    self._windows(s, s - width + 1, pos[of], doc[of], item[of], h, at, edge, begin, found)
        return [(r, k, sim, start, n) for (r, k), (sim, start, n) in found.items()]

    def _near(self, bits: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether each fingerprint lies within RADIUS of its item's; a byte within RADIUS // 8 is asked for first."""
        apart = _BITS[bits ^ self.prints[items]]
        ok = apart.min(axis=1) <= RADIUS // 8
        ok[ok] = apart[ok].sum(axis=1, dtype=np.int64) <= RADIUS
        return ok

    def _whole(self, docs, items, h, edge, begin, found) -> None:
        """Compares documents of fewer words than an item as they are with it."""
        pairs = np.unique(np.stack([docs, items]), axis=1)
        for d in np.unique(pairs[0]).tolist():
            own, of = h[edge[d] : edge[d + 1]], pairs[1, pairs[0] == d]
            for k in of[self._near(fingerprint(own)[None], of)].tolist():
                if (sim := self.similarity(k, own)) >= SIMILARITY:
                    found[d, k] = (sim, 0, int(begin[d + 1] - begin[d]))

    def _windows(self, size, m, pos, docs, items, h, at, edge, begin, found) -> None:
        """Fingerprints the windows of size words (m shingles) around each hit and keeps the best for its item."""
        order = np.lexsort((pos, items))
        pos, docs, items = pos[order], docs[order], items[order]
        first, last = np.maximum(pos - m + 1, edge[docs]), np.minimum(pos, edge[docs + 1] - m)
        again = np.concatenate([[False], items[1:] == items[:-1]])
        first[again] = np.maximum(first[again], last[:-1][again[1:]] + 1)  # each window once for an item
        n = np.maximum(last - first + 1, 0)
        upto = np.cumsum(n)
        x = 0
        while x < len(n):
            y = max(x + 1, int(np.searchsorted(upto, upto[x] - n[x] + PAIRS, "right")))
            win, item, doc = ragged(first[x:y], n[x:y]), np.repeat(items[x:y], n[x:y]), np.repeat(docs[x:y], n[x:y])
            x = y
            if not len(win):
                continue
            places, back = np.unique(win, return_inverse=True)
            close = np.flatnonzero(self._near(_window_prints(h, places, m)[back], item))
            for w, k, d in zip(win[close].tolist(), item[close].tolist(), doc[close].tolist()):
                sim = self.similarity(k, h[w : w + m])
                start = int(at[w] - begin[d])
                old = found.get((d, k))
                if sim >= SIMILARITY and (old is None or (sim, -start) > (old[0], -old[1])):
                    found[d, k] = (sim, start, size)


def _slices(benchmark: DataFrame):
    """Broadcast indexes of the benchmark, each of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(n_bytes // SLICE_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of every contaminated pair."""

    def scan(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = items.value
            for batch in batches:
                ids = batch.column(0)
                for a, _, data, offs in blocks(batch.column(1)):
                    got = sorted(index.scan(data, offs))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([a + r for r, *_ in got], pa.int64())),
                            pa.array([index.ids[k] for _, k, *_ in got], pa.int64()),
                            pa.array([s for _, _, s, _, _ in got], pa.float64()),
                            pa.array([w for _, _, _, w, _ in got], pa.int64()),
                            pa.array([n for *_, n in got], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "similarity", "start_word", "n_words"],
                    )

        return run

    out = None
    for items in _slices(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(scan(items), "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", (-F.col("m.s")).alias("start_word"), "m.n_words")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; decided row by row, so nothing is shuffled."""

    def clean(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = items.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, data, offs in blocks(batch.column(0)):
                    keep[[a + r for r, *_ in index.scan(data, offs)]] = False
                out = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
                yield out.filter(pa.array(keep))

        return run

    for items in _slices(benchmark):
        docs = leading(docs, "text").mapInArrow(clean(items), docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
