"""A boosted listwise ranker (LambdaMART), grown for all evaluation periods at once on Spark.

A period is a group.  A pair of a positive and a negative alert pulls apart with the weight of the change in NDCG at
``truncation`` that swapping them makes; alerts ranked deeper have discount zero, so every pair that counts has a member
among a period's first ``truncation`` alerts.  That bounds what must be known of a period: a round first finds those
lists (each task its own, then one small merge a period), and every other alert's gradient follows from the list of its
period, in whatever task it lies.  What the others do to the listed alerts is added up by the tasks.  No task holds a
period, and no pair is formed between alerts outside the lists.

Features are cut into bins once, at quantiles of the periods before the first model's.  Trees grow level by level, one
pass over the alerts a level: tasks add up (gradient, hessian, count) by model, node, feature and bin, a shuffle adds
the tasks' histograms, and the driver, which also adds the listed alerts (at most truncation a period and model), picks
the splits.  Gradients are whole multiples of 2**-30, so sums do not depend on how rows are dealt, and a model comes out
the same after a lost executor.  Scores are kept in the packed table of alerts, rewritten every SETTLE rounds.

``contributions`` are exact Shapley values of a model's trees along their paths (TreeSHAP), ``importance`` the gains
of its splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators.features import feature_columns
from triagelake.params import Boost
from triagelake.session import settled

#: Alerts of a packed row, rounds between two writes of the scores, models that are trained together.
BLOCK, SETTLE, TOGETHER = 4096, 10, 32
_UNIT = float(1 << 30)


@dataclass
class Tree:
    """Nodes as lists: feature (-1 for a leaf), the last bin that goes left, children, value, alerts and gain of the split."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: int) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, left, right

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        at = np.zeros(len(bins), np.int64)
        f, cut, left, right = (np.array(x, np.int64) for x in (self.feature, self.cut, self.left, self.right))
        row = np.flatnonzero(f[at] >= 0)
        while len(row):
            now = at[row]
            at[row] = np.where(bins[row, f[now]] <= cut[now], left[now], right[now])
            row = row[f[at[row]] >= 0]
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]

    def paths(self) -> Iterator[tuple[float, dict[int, tuple[float, int, int]]]]:
        """Each leaf's value, and for each feature on its path the share of alerts that goes on, and the bins (first, last) that do."""

        def walk(node: int, seen: dict):
            f = self.feature[node]
            if f < 0:
                yield self.value[node], seen
                return
            share, low, high = seen.get(f, (1.0, 0, 1 << 30))
            for child, bounds in ((self.left[node], (low, min(high, self.cut[node]))), (self.right[node], (max(low, self.cut[node] + 1), high))):
                yield from walk(child, seen | {f: (share * self.cover[child] / self.cover[node], *bounds)})

        yield from walk(0, {})


def shapley(trees: list[Tree], bins: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows by features) of the trees' sum, and the base value; together they add up to the score.

    A feature that is not known leads down both ways by the trees' covers.  For a leaf whose path asks d features, the
    value of one is (o - z) times the sum over subsets of the others of s! (d - s - 1)! / d! times the o of those in it
    and the z of those outside, o being 1 where the row passes the feature's conditions and z the share that does; the
    subsets of each size are the coefficients of the product of (z + o t).
    """
    out, base = np.zeros(bins.shape), 0.0
    for tree in trees:
        for value, path in tree.paths():
            base += value * math.prod(z for z, _, _ in path.values())
            d, items = len(path), list(path.items())
            passes = [((bins[:, f] >= low) & (bins[:, f] <= high)).astype(float) for f, (_, low, high) in items]
            for k, (f, (z, _, _)) in enumerate(items):
                sizes = [np.ones(len(bins))]
                for j, (_, (other, _, _)) in enumerate(items):
                    if j != k:
                        sizes = [(sizes[s] * other if s < len(sizes) else 0) + (sizes[s - 1] * passes[j] if s else 0) for s in range(len(sizes) + 1)]
                total = sum(c * (math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)) for s, c in enumerate(sizes))
                out[:, f] += value * (passes[k] - z) * total
    return out, base


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix of values: the number of edges below each; one byte a value."""
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _values(names: list[str]):
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


class LambdaMart:
    """A trained model: feature names, bin edges and trees."""

    def __init__(self, names: list[str], edges: list[np.ndarray], trees: list[Tree]):
        self.names, self.edges, self.trees = names, edges, trees

    def values(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        return sum((t.values(bins) for t in self.trees), np.zeros(len(x)))

    def score(self, rows: DataFrame) -> DataFrame:
        return scored(rows, self, "score")

    def importance(self) -> list[tuple[str, float]]:
        """Each feature's gains over all splits."""
        gains = dict.fromkeys(self.names, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gains[self.names[f]] += g
        return sorted(gains.items(), key=lambda x: (-x[1], x[0]))

    def contributions(self, rows: DataFrame, top: int = 5) -> DataFrame:
        """(alert_id, feature, value, contribution): the largest Shapley values of each score; ties by feature name."""
        names, order = self.names, np.argsort(self.names)
        sent = rows.sparkSession.sparkContext.broadcast((self.edges, self.trees))  # bounded by the rounds and leaves

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges, trees = sent.value
            for batch in batches:
                x = _matrix(batch.column(1), len(names))
                parts, _ = shapley(trees, _binned(x, edges))
                best = order[np.argsort(-np.abs(parts[:, order]), axis=1, kind="stable")[:, :top]]
                row = np.repeat(np.arange(len(x)), best.shape[1])
                f = best.ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array([names[k] for k in f], pa.string()), pa.array(x[row, f]), pa.array(parts[row, f])], names=["alert_id", "feature", "value", "contribution"]
                )

        return rows.select("alert_id", _values(names).alias("x")).mapInArrow(run, "alert_id string, feature string, value double, contribution double")


def scored(features: DataFrame, model: LambdaMart | dict[str, LambdaMart], name: str) -> DataFrame:
    """features' keys with a score: of one model, or for each row of the model of its day (days without one are left out)."""
    names = model.names if isinstance(model, LambdaMart) else next(iter(model.values())).names
    sent = features.sparkSession.sparkContext.broadcast(model)  # bounded by the rounds, leaves and periods
    day = F.to_date("period_start").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            x = _matrix(batch.column(3), len(names))
            if isinstance(of, LambdaMart):
                score = of.values(x)
            else:
                days, score = np.array(batch.column(2).to_pylist(), object), np.zeros(len(x))
                for d in set(days):
                    score[days == d] = of[d].values(x[days == d])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["alert_id", "period_start", name])

    rows = features if isinstance(model, LambdaMart) else features.where(day.isin(*model))
    return rows.select("alert_id", "period_start", day.alias("day"), _values(names).alias("x")).mapInArrow(run, f"alert_id string, period_start timestamp_ntz, {name} double")


# ---- training


def _discounts(n: int) -> np.ndarray:
    return 1 / np.log2(2 + np.arange(n))


def _pull(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How strongly the first scores should still rise over the second ones."""
    return 1 / (1 + np.exp(np.clip(high - low, -700, 700)))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _UNIT).astype(np.int64)


@dataclass
class Listed:
    """The first alerts of a period under a model, in order: scores, ids, labels, bins and discounts over the best DCG."""

    score: np.ndarray
    id: np.ndarray
    label: np.ndarray
    bins: np.ndarray
    weight: np.ndarray
    whole: bool  # the period has no other alerts

    def among(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians from the pairs inside the list."""
        g, h = np.zeros(len(self.score)), np.zeros(len(self.score))
        p, n = np.flatnonzero(self.label), np.flatnonzero(self.label == 0)
        pull = _pull(self.score[p][:, None], self.score[n])
        change = np.abs(self.weight[p][:, None] - self.weight[n])
        g[p], g[n] = (pull * change).sum(axis=1), -(pull * change).sum(axis=0)
        h[p], h[n] = (pull * (1 - pull) * change).sum(axis=1), (pull * (1 - pull) * change).sum(axis=0)
        return _whole(g), _whole(h)

    def below(self, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        last, last_id = self.score[-1], self.id[-1]
        return (score < last) | ((score == last) & (ids > last_id))

    def with_others(self, score: np.ndarray, label: np.ndarray):
        """Of alerts outside the list: their gradients and hessians, and what they add to those of the list."""
        g, h = np.zeros(len(score)), np.zeros(len(score))
        own_g, own_h = np.zeros(len(self.score)), np.zeros(len(self.score))
        for good in (0, 1):
            mine, theirs = np.flatnonzero(label == good), np.flatnonzero(self.label != good)
            s, t = score[mine][:, None], self.score[theirs]
            pull = _pull(s, t) if good else _pull(t, s)
            move, curve = pull * self.weight[theirs], pull * (1 - pull) * self.weight[theirs]
            sign = 1 if good else -1
            g[mine], h[mine] = sign * move.sum(axis=1), curve.sum(axis=1)
            own_g[theirs], own_h[theirs] = -sign * move.sum(axis=0), curve.sum(axis=0)
        return _whole(g), _whole(h), _whole(own_g), _whole(own_h)


def _histogram(bins: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, n_bins: int) -> np.ndarray:
    """(slots, features, bins, 3) sums of whole gradients, hessians and counts."""
    rows, width = bins.shape
    at = ((slot[:, None] * width + np.arange(width)) * n_bins + bins).ravel()
    size = slots * width * n_bins
    parts = [np.bincount(at, np.repeat(x, width).astype(float), size).astype(np.int64) for x in (g, h)] + [np.bincount(at, minlength=size)]
    return np.stack(parts, axis=-1).reshape(slots, width, n_bins, 3)


def _filled(x: np.ndarray) -> bytes:
    """Places and values of what is not zero: few bins of a small node hold anything."""
    at = np.flatnonzero(x)
    return at.astype(np.int64).tobytes() + x[at].tobytes()


def _added(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of several ``_filled``."""
    both = [np.frombuffer(p, np.int64).reshape(2, -1) for p in parts]
    at, back = np.unique(np.concatenate([p[0] for p in both]), return_inverse=True)
    total = np.zeros(len(at), np.int64)
    np.add.at(total, back, np.concatenate([p[1] for p in both]))
    return at, total


def _packed(rows: DataFrame, counts: DataFrame, edges: list[np.ndarray], parts: int) -> DataFrame:
    """Alerts (day, id, label, x) in rows of about BLOCK alerts of one day: ids, labels, bins, and no scores yet."""
    width = len(edges)

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        x = _matrix(t.column("x").combine_chunks(), width)[order]
        made = [t.column("id").to_numpy()[order], t.column("label").to_numpy()[order].astype(np.uint8), _binned(x, edges)]
        return pa.table({"day": t.column("day").slice(0, 1), **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("ids", "labels", "bins"), made)}, "scores": pa.array([b""], pa.binary())})

    share = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / BLOCK).cast("long"))
    dealt = rows.join(F.broadcast(counts.select("day", "n")), "day").withColumn("part", share)  # one row a period
    packed = dealt.select("day", "part", "id", "label", "x").groupBy("day", "part").applyInArrow(pack, "day string, ids binary, labels binary, bins binary, scores binary")
    return settled(packed.repartition(parts))


class _Training:
    """Several models grown side by side over one packed table."""

    def __init__(self, blocks: DataFrame, days: list[str], counts: dict[str, tuple[int, int]], edges: list[np.ndarray], boost: Boost):
        self.blocks, self.days, self.counts, self.edges, self.boost = blocks, days, counts, edges, boost
        self.n_bins, self.width = 1 + max((len(e) for e in edges), default=0), len(edges)
        self.trees: list[list[Tree]] = [[] for _ in days]
        self.pending: list[list[Tree]] = [[] for _ in days]

    def _each(self):
        """A function over batches of the table: (day, ids, labels, bins, first model that learns from the day, its and the later models' scores)."""
        days, pending, width = self.days, self.pending, self.width

        def each(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for day, ids, labels, bins, scores in zip(*(c.to_pylist() for c in batch.columns)):
                    ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.uint8)
                    bins = np.frombuffer(bins, np.uint8).reshape(len(ids), width)
                    first = next((m for m, d in enumerate(days) if d > day), len(days))
                    known = np.frombuffer(scores, np.float64).reshape(-1, len(ids)).copy() if scores else np.zeros((len(days) - first, len(ids)))
                    for s, trees in zip(known, pending[first:]):
                        for t in trees:
                            s += t.values(bins)
                    yield day, ids, labels, bins, first, known

        return each

    def settle(self) -> None:
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for day, ids, labels, bins, _, known in each(batches):
                yield pa.RecordBatch.from_pylist([{"day": day, "ids": ids.tobytes(), "labels": labels.tobytes(), "bins": bins.tobytes(), "scores": known.tobytes()}], shape)

        shape = pa.schema([("day", pa.string()), *[(n, pa.binary()) for n in ("ids", "labels", "bins", "scores")]])
        self.blocks = settled(self.blocks.mapInArrow(run, self.blocks.schema))
        self.pending = [[] for _ in self.days]

    def _learns(self, m: int, day: str) -> bool:
        n, good = self.counts[day]
        return day < self.days[m] and 0 < good < n

    def lists(self) -> dict[tuple[int, str], Listed]:
        """For each model and period that it learns from, the period's first alerts."""
        each, most, counts, width = self._each(), self.boost.truncation, self.counts, self.width
        names = ("score", "id", "label", "bins")
        kinds = (np.float64, np.int64, np.uint8, np.uint8)

        def first(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            got = [np.concatenate(x) for x in zip(*parts)]
            order = np.lexsort((got[1], -got[0]))[:most]
            return [x[order] for x in got]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, str], list[np.ndarray]] = {}
            for day, ids, labels, bins, start, known in each(batches):
                n, good = counts[day]
                for m, s in enumerate(known, start) if 0 < good < n else ():
                    own = [s, ids, labels, bins]
                    best[m, day] = first([best[m, day], own] if (m, day) in best else [own])
            yield pa.RecordBatch.from_pylist([{"model": m, "day": d, **{n: x.tobytes() for n, x in zip(names, v)}} for (m, d), v in best.items()], shape)

        def join(t: pa.Table) -> pa.Table:
            rows = [[np.frombuffer(r[n], k) for n, k in zip(names, kinds)] for r in t.to_pylist()]
            got = first([[*r[:3], r[3].reshape(-1, width)] for r in rows])
            return pa.table({"model": t.column("model").slice(0, 1), "day": t.column("day").slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, got)}})

        shape = pa.schema([("model", pa.int32()), ("day", pa.string()), *[(n, pa.binary()) for n in names]])
        kind = "model int, day string, " + ", ".join(f"{n} binary" for n in names)
        out = {}
        for r in self.blocks.mapInArrow(run, kind).groupBy("model", "day").applyInArrow(join, kind).collect():  # truncation alerts a period and model
            score, ids, label, bins = (np.frombuffer(r[n], k) for n, k in zip(names, kinds))
            n, good = counts[r.day]
            weight = _discounts(len(score)) / _discounts(min(good, most)).sum()
            out[r.model, r.day] = Listed(score, ids, label, bins.reshape(-1, width), weight, n <= most)
        return out

    def sums(self, lists: dict, growing: list[Tree], slots: list[dict[int, int]], level: int):
        """Histograms of the alerts outside the lists by model and open node, and at level 0 what they add to the lists' gradients."""
        each, n_bins, learns = self._each(), self.n_bins, self._learns
        sent = self.blocks.sparkSession.sparkContext.broadcast({k: v for k, v in lists.items() if not v.whole})  # truncation alerts a period and model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, str], np.ndarray] = {}
            lists = sent.value
            for day, ids, labels, bins, start, known in each(batches):
                for m, s in enumerate(known, start):
                    if (m, day) not in lists or not slots[m]:
                        continue
                    top = lists[m, day]
                    rest = np.flatnonzero(top.below(s, ids))
                    g, h, own_g, own_h = top.with_others(s[rest], labels[rest])
                    slot = np.full(len(growing[m].feature), -1)
                    slot[list(slots[m])] = list(slots[m].values())
                    at = slot[growing[m].nodes(bins[rest])]
                    ok = at >= 0
                    add = [((m, ""), _histogram(bins[rest[ok]], at[ok], len(slots[m]), g[ok], h[ok], n_bins))]
                    if not level:
                        add.append(((m, day), np.stack([own_g, own_h])))
                    for key, x in add:
                        found[key] = found[key] + x if key in found else x
            yield pa.RecordBatch.from_pylist([{"model": m, "day": d, "sums": _filled(x.ravel())} for (m, d), x in found.items()], shape)

        def join(t: pa.Table) -> pa.Table:
            at, total = _added(t.column("sums").to_pylist())
            return pa.table({"model": t.column("model").slice(0, 1), "day": t.column("day").slice(0, 1), "sums": pa.array([at.tobytes() + total.tobytes()], pa.binary())})

        shape = pa.schema([("model", pa.int32()), ("day", pa.string()), ("sums", pa.binary())])
        kind = "model int, day string, sums binary"
        if not sent.value:
            return {}
        got = self.blocks.mapInArrow(run, kind).groupBy("model", "day").applyInArrow(join, kind).collect()  # one histogram a model, one list a period
        sent.unpersist()
        return {(r.model, r.day): np.frombuffer(r.sums, np.int64).reshape(2, -1) for r in got}

    def round(self) -> None:
        """One tree more for every model."""
        boost, lists = self.boost, self.lists()
        growing, slots = [Tree() for _ in self.days], [{0: 0} for _ in self.days]
        for t in growing:
            t.add(0.0, 0)
        leaves = [1] * len(self.days)
        own = {k: list(v.among()) for k, v in lists.items()}
        by_model: list[list[str]] = [[] for _ in self.days]
        for m, day in sorted(lists):
            by_model[m].append(day)
        for level in range(boost.depth):
            found = self.sums(lists, growing, slots, level)
            if not level:
                for key, x in found.items():
                    if key[1]:
                        more = np.zeros(2 * len(own[key][0]), np.int64)
                        more[x[0]] = x[1]
                        own[key] = [a + b for a, b in zip(own[key], more.reshape(2, -1))]
            for m, tree in enumerate(growing):
                if not slots[m] or not by_model[m]:
                    slots[m] = {}
                    continue
                bins = np.concatenate([lists[m, d].bins for d in by_model[m]])
                g, h = (np.concatenate([own[m, d][k] for d in by_model[m]]) for k in (0, 1))
                slot = np.full(len(tree.feature), -1)
                slot[list(slots[m])] = list(slots[m].values())
                at = slot[tree.nodes(bins)]
                hist = _histogram(bins[at >= 0], at[at >= 0], len(slots[m]), g[at >= 0], h[at >= 0], self.n_bins)
                if (m, "") in found:
                    hist.reshape(-1)[found[m, ""][0]] += found[m, ""][1]
                leaves[m], slots[m] = grow(tree, slots[m], hist, leaves[m], boost)
            if not any(slots):
                break
        for m, tree in enumerate(growing):
            self.trees[m].append(tree)
            self.pending[m].append(tree)


def grow(tree: Tree, slots: dict[int, int], hist: np.ndarray, leaves: int, boost: Boost) -> tuple[int, dict[int, int]]:
    """Splits the open nodes (node to its place in hist), best gain first, and gives the number of leaves and the new open nodes.

    Of equal gains the first node, feature and bin count.
    """
    found = []
    for node, k in slots.items():
        total = hist[k, 0].sum(axis=0)
        left = np.cumsum(hist[k], axis=1)[:, :-1]  # (features, cuts, 3)
        right = total - left
        part = lambda x: (x[..., 0] / _UNIT) ** 2 / (x[..., 1] / _UNIT + boost.l2)
        gain = part(left) + part(right) - part(total)
        gain = np.where((left[..., 2] >= boost.least_rows) & (right[..., 2] >= boost.least_rows), gain, 0.0)
        if not node:
            tree.cover[0] = int(total[2])
        if gain.size and gain.max() > 1e-12:
            f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
            found.append((-float(gain[f, cut]), node, int(f), int(cut), left[f, cut], right[f, cut]))
    fresh = []
    for gain, node, f, cut, *sides in sorted(found, key=lambda x: x[:2]):
        if leaves < boost.leaves:
            made = [tree.add(boost.rate * (s[0] / _UNIT) / (s[1] / _UNIT + boost.l2), int(s[2])) for s in sides]
            tree.split(node, f, cut, -gain, *made)
            fresh += made
            leaves += 1
    return leaves, {node: k for k, node in enumerate(fresh)} if leaves < boost.leaves else {}


def lambdamart_models(features: DataFrame, prepared: DataFrame, start: str, boost: Boost) -> dict[str, LambdaMart]:
    """One model for each evaluation day, trained on the periods strictly before it; days without a pair before have none."""
    from triagelake.operators.ranker import _no_outcomes

    _no_outcomes(features)
    names, spark = feature_columns(features), features.sparkSession
    known = prepared.select("alert_id", F.col("is_true_positive").cast("int").alias("label"))
    rows = settled(features.join(known, "alert_id").select(F.to_date("period_start").cast("string").alias("day"), F.xxhash64("alert_id").alias("id"), "label", _values(names).alias("x")))
    counts = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    of_day = {r.day: (r.n, r.good) for r in counts.collect()}  # one row a period
    seen = {d: sum(g * (n - g) for p, (n, g) in of_day.items() if p < d) for d in of_day}
    days = sorted(d for d in of_day if d >= start and seen[d])
    if not days:
        return {}
    fractions = [k / boost.bins for k in range(1, boost.bins)]
    cuts = rows.where(F.col("day") < days[0]).agg(*[F.percentile_approx(F.col("x")[k], fractions, 10000).alias(f"e{k}") for k in range(len(names))]).first()
    edges = [np.unique(np.array(e, float)) for e in cuts]
    table = spark.createDataFrame([(d, n) for d, (n, _) in of_day.items()], "day string, n long")
    size = sum(-(-n // BLOCK) for n, _ in of_day.values())
    blocks = _packed(rows.where(F.col("day") < days[-1]), table, edges, min(-(-size // 4), 3 * spark.sparkContext.defaultParallelism))
    out = {}
    for k in range(0, len(days), TOGETHER):
        training = _Training(blocks, days[k : k + TOGETHER], of_day, edges, boost)
        for r in range(boost.rounds):
            training.round()
            if r % SETTLE == SETTLE - 1 and r < boost.rounds - 1:
                training.settle()
        out |= {d: LambdaMart(names, edges, trees) for d, trees in zip(training.days, training.trees)}
    return out
