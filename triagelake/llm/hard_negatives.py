"""Hard-negative mining by bit-sliced integer products.

A component x counts as the integer floor(256 x), and a score is the integer inner product of a row and an anchor.
Rows are cut into bit-planes; planes are multiplied with the anchors most significant first, so after each plane a
score lies in an interval that halves in width, and pairs whose interval cannot qualify any more are dropped.  While
many pairs are left a plane is one matrix product, then only the pairs that are left are read.  What survives the last
plane has its exact score.

Two searches run over all rows for each anchor: the best rows of its label (its positives), and for each positive the
best rows of other labels within a share of the positive's score.  A task keeps the best of its own rows for each
anchor, which also bounds what later rows must reach, and sends only these; one aggregation joins the tasks' lists.
Anchors are taken in chunks of at most CHUNK_BYTES, broadcast with each chunk's positives; each chunk reads all rows.

Edge cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; vectors
of unequal length are compared as if the shorter went on with zeros; an anchor is told from other rows by its id; of
rows of equal id and score one counts, so repeated rows count once, and anchors that agree in all columns are one;
equal scores go by the smaller id; components over WIDE and vectors over LONG are multiplied in Python integers, and
scores outside 64 bits become the nearest 64-bit number; an anchor without positives or a positive without negatives
gives no row; further columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.common import table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Bytes of anchors (four a component) that are broadcast at once.
CHUNK_BYTES = 16 << 20
#: Rows and anchors of one matrix product, rows of the first one, and the share of pairs from which on they are read one by one.
ROWS, ANCHORS, FIRST_ROWS, SPARSE = 4096, 512, 256, 0.04
#: Integers up to which, and vector lengths up to which, all sums are exact in doubles: 20 + 20 + 12 bits.
WIDE, LONG = 1 << 20, 1 << 12
_LEAST, _MOST = -(2**63), 2**63 - 1


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of the first ``width`` components of each vector, zeros behind its end, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        return np.floor(SCALE * flat.reshape(len(n), width))
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    ok = at < width
    out[row[ok], at[ok]] = np.floor(SCALE * flat[ok])
    return out


class Planes:
    """A block of rows as bit-planes of the components' distance from the least integer of their width."""

    def __init__(self, q: np.ndarray):
        self.bits = 1
        while len(q) and (q.min() < -(1 << (self.bits - 1)) or q.max() >= 1 << (self.bits - 1)):
            self.bits += 1
        self.low = -(1 << (self.bits - 1))
        self.u = (q - self.low).astype(np.int64)

    def plane(self, t: int, kind) -> np.ndarray:
        return ((self.u >> t) & 1).astype(kind)


def surviving(rows: Planes, a: np.ndarray, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs in ``alive`` whose score is from least to most of its anchor."""
    kind = np.float32 if np.abs(a).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    up, down, at = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1), a.astype(kind)
    s = np.broadcast_to(rows.low * a.sum(axis=1), alive.shape).copy()
    pair = None
    for t in range(rows.bits - 1, -1, -1):
        bits, rest = rows.plane(t, kind), (1 << t) - 1
        if pair is None:
            s += float(1 << t) * (bits @ at.T)
            alive = alive & (s >= least - rest * up) & (s <= most - rest * down)
            if np.count_nonzero(alive) <= SPARSE * alive.size or not t:
                r, c = np.nonzero(alive)
                pair = r, c, s[r, c]
        else:
            r, c, v = pair
            for k in range(0, len(r), 1 << 15):
                part = slice(k, k + (1 << 15))
                v[part] += float(1 << t) * np.einsum("ij,ij->i", bits[r[part]], at[c[part]])
            ok = (v >= least[c] - rest * up[c]) & (v <= most[c] - rest * down[c])
            pair = r[ok], c[ok], v[ok]
    r, c, v = pair
    return r, c, v.astype(np.int64)


def wide_scores(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact scores of integers of any size, brought into 64 bits."""
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in a], object).reshape(a.shape).T
    return np.array([[min(max(int(x), _LEAST), _MOST) for x in r] for r in exact], np.int64).reshape(len(q), len(a))


class Best:
    """The best entries of each slot so far: highest scores, of equal ones the smallest ids; equal entries once."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # what an entry must reach

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        ok = rank < self.keep
        full = rank == self.keep - 1
        self.least[slot[full]] = score[full]
        self.slot, self.score, self.id = slot[ok], score[ok], ids[ok]


def _sizes(n: int, first: bool) -> Iterator[tuple[int, int]]:
    """Bounds of row blocks; the first ones are small, as what they find bounds the later ones."""
    at, size = 0, FIRST_ROWS if first else ROWS
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(2 * size, ROWS)


def _search(batches: Iterator[pa.RecordBatch], ids, labels, a, seek) -> None:
    """Feeds ``seek(rows' ids, rows' labels, anchors' places, alive, find)`` with blocks of rows and tiles of anchors.

    find(least, most) gives (row, anchor in the tile, score) of the alive pairs within bounds.
    """
    narrow = np.abs(a).max(axis=1, initial=0) < WIDE if a.shape[1] <= LONG else np.zeros(len(a), bool)
    tiles = [(t, of) for t in (True, False) for of in [np.flatnonzero(narrow == t)]]
    first = True
    for batch in batches:
        q = integers(batch.column(2), a.shape[1])
        row_id, row_label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        slim = np.abs(q).max(axis=1, initial=0) < WIDE
        for x, y in _sizes(len(q), first):
            for ok, wide in ((np.flatnonzero(slim[x:y]) + x, False), (np.flatnonzero(~slim[x:y]) + x, True)):
                if not len(ok):
                    continue
                planes = None if wide else Planes(q[ok])
                for easy, of in tiles:
                    for k in range(0, len(of), ANCHORS):
                        tile = of[k : k + ANCHORS]
                        same = row_label[ok][:, None] == labels[tile]
                        if easy and not wide:
                            seek(row_id[ok], same, tile, lambda alive, least, most, p=planes, t=tile: surviving(p, a[t], alive, least, most))
                        else:
                            score = wide_scores(q[ok], a[tile])

                            def find(alive, least, most, s=score):
                                r, c = np.nonzero(alive)
                                fits = (s[r, c] >= least[c]) & (s[r, c] <= most[c])
                                return r[fits], c[fits], s[r[fits], c[fits]]

                            seek(row_id[ok], same, tile, find)
        first = False


def _emit(best: Best, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id)], names=names)


def _joined(found: DataFrame, keep: int) -> DataFrame:
    """(slot, at, score, id): the best of all tasks' entries, at most ``keep`` of each task and slot."""
    order = F.array_sort(F.collect_set(F.struct(F.expr("~score").alias("down"), "id")))
    rows = found.groupBy("slot").agg(F.slice(order, 1, keep).alias("x")).select("slot", F.posexplode("x").alias("at", "x"))
    return rows.select("slot", (F.col("at") + 1).alias("at"), F.expr("~x.down").alias("score"), "x.id")


def _positives(rows: DataFrame, sent, keep: int) -> DataFrame:
    """(slot, at, score, id): each anchor's best other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, a = sent.value
        best = Best(len(ids), keep)

        def seek(row_id, same, tile, find):
            alive = same & (row_id[:, None] != ids[tile])
            r, c, score = find(alive, best.least[tile], np.full(len(tile), np.inf))
            best.add(tile[c], score, row_id[r])

        _search(batches, ids, labels, a, seek)
        yield _emit(best, ["slot", "score", "id"])

    return _joined(rows.mapInArrow(run, "slot bigint, score bigint, id bigint"), keep)


def _negatives(rows: DataFrame, sent, slots, keep: int) -> DataFrame:
    """(slot, at, score, id): for each slot (anchor, least, most) the best rows of another label within its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, a = sent.value
        anchor, least, most = slots.value  # by anchor
        best = Best(len(anchor), keep)
        begin = np.searchsorted(anchor, np.arange(len(ids) + 1))
        has = np.flatnonzero(np.diff(begin))

        def seek(row_id, same, tile, find):
            lo, hi = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            if len(has):
                lo[has] = np.minimum.reduceat(np.maximum(least, best.least), begin[has])
                hi[has] = np.maximum.reduceat(most, begin[has])
            r, c, score = find(~same, lo[tile], hi[tile])
            n = np.diff(begin)[tile[c]]
            of = np.repeat(np.arange(len(r)), n)
            slot = np.repeat(begin[tile[c]] - (np.cumsum(n) - n), n) + np.arange(len(of))
            fits = (score[of] >= np.maximum(least, best.least)[slot]) & (score[of] <= most[slot])
            best.add(slot[fits], score[of[fits]], row_id[r[of[fits]]])

        _search(batches, ids, labels, a, seek)
        yield _emit(best, ["slot", "score", "id"])

    return _joined(rows.mapInArrow(run, "slot bigint, score bigint, id bigint"), keep)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.abs(x) < float("inf"))  # null or false for a null or a NaN
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


def _chunks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and integers of the anchors, at most about CHUNK_BYTES at a time."""
    anchors = anchors.dropDuplicates()
    size = anchors.agg(F.sum(4 * F.size("embedding"))).first()[0] or 0
    n = int(-(-size // CHUNK_BYTES))
    for k in range(n):
        part = anchors.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)) == k).toArrow()
        if part.num_rows:
            vectors = part.column("embedding").combine_chunks()
            width = int(np.diff(vectors.offsets.to_numpy()).max())
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), integers(vectors, width)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` are rows of the same kind.  A negative's score is from ``low`` to ``high`` percent of the positive's.
    """
    rows, out = usable(rows), None
    context = rows.sparkSession.sparkContext
    for ids, labels, a in _chunks(usable(anchors)):
        sent = context.broadcast((ids, labels, a))
        found = sorted((r.slot, r.at, r.score, r.id) for r in _positives(rows, sent, positives).collect())  # a few for each anchor of the chunk
        bounds = [(s, -(-low * p // 100), high * p // 100, i, p) for s, _, p, i in found]
        bounds = [b for b in bounds if b[1] <= b[2]]
        if not bounds:
            continue
        slot, least, most, other, score = (np.array(x, np.int64) for x in zip(*bounds))
        slots = context.broadcast((slot, least, most))
        names = rows.sparkSession.createDataFrame(pa.table({"slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": other, "positive_score": score}))
        best = _negatives(rows, sent, slots, negatives).join(F.broadcast(names), "slot")  # the chunk's positives
        part = best.select("anchor_id", "positive_id", F.col("at").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM pos p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
