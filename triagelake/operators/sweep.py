"""Counting pairs of payments without forming them: payments in and out of one account on one day.

A payment out matches one in if it comes within a span of time after it and differs by at most a share of it.  In the
order of time a payment's matches lie in one range, in the order of amounts in another, so the number of its matches is
a count of points in a rectangle.  ``in_rectangles`` answers many such counts from sorted runs of doubling length
(merge-sort counting), in n log(n) for n payments and as much for their queries; the pairs may be as many as n squared.
"""

from __future__ import annotations

import numpy as np


def in_rectangles(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query the number of places p with low <= p < high and least <= ranks[p] < most."""
    n, out = len(ranks), np.zeros(len(low), np.int64)
    low, high = low.astype(np.int64), np.maximum(high, low).astype(np.int64)
    size = 1
    while True:
        # the run of this length that a range begins or ends with, if its bound does not fit the next length
        left, right = np.flatnonzero((low < high) & (low // size % 2 == 1)), np.flatnonzero((low < high) & (high // size % 2 == 1))
        if len(left) or len(right):
            keys = np.sort(np.arange(n) // size * (n + 1) + ranks)
            at = lambda run, bound, k=keys: np.searchsorted(k, run * (n + 1) + np.clip(bound, 0, n))
            for which, run in ((left, low[left] // size), (right, high[right] // size - 1)):
                out[which] += np.maximum(at(run, most[which]) - at(run, least[which]), 0)
        low[left] += size
        high[right] -= size
        size *= 2
        if not (low < high).any():
            return out


def amount_ranges(into: np.ndarray, out: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each amount in, the range of the ascending amounts out with |out - in| <= in * tolerance, rounding and all."""
    ok = lambda at: np.abs(out[np.clip(at, 0, len(out) - 1)] - into) <= into * tolerance
    low, high = np.searchsorted(out, into - into * tolerance, "left"), np.searchsorted(out, into + into * tolerance, "right")
    while True:  # a bound is at most some last digits off
        more = (low > 0) & ok(low - 1)
        less = (low < high) & ~ok(low)
        up = (high < len(out)) & ok(high)
        down = (high > low) & ~ok(high - 1)
        if not (more | less | up | down).any():
            return low, high
        low, high = low - more + less, high + up - down


def matches(in_ts: np.ndarray, into: np.ndarray, out_ts: np.ndarray, out: np.ndarray, tolerance: float, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Each payment in's number of matches, and whether each payment out has one.

    A match comes from 0 to less than span time units after the payment in.  Accounts may be swept together if their
    times lie a span apart.
    """
    by_time, by_amount = np.argsort(out_ts, kind="stable"), np.argsort(out, kind="stable")
    rank = np.empty(len(out), np.int64)
    rank[by_amount] = np.arange(len(out))
    ascending, times = out[by_amount], out_ts[by_time]
    least, most = amount_ranges(into, ascending, tolerance)
    counts = in_rectangles(rank[by_time], np.searchsorted(times, in_ts, "left"), np.searchsorted(times, in_ts + span, "left"), least, most)
    # the other way round: a payment out is matched by the payments in of a range of time whose ranges hold it
    order, when = np.argsort(into, kind="stable"), np.argsort(in_ts, kind="stable")
    place = np.empty(len(into), np.int64)
    place[order] = np.arange(len(into))
    least, most, times = least[order], most[order], in_ts[when]
    if (np.diff(least) < 0).any() or (np.diff(most) < 0).any():  # rounding has crossed two neighbouring ranges
        hit = np.zeros(len(out), bool)
        for k in range(len(into)):
            a, b = np.searchsorted(out_ts[by_time], [in_ts[k], in_ts[k] + span])
            part = by_time[a:b]
            hit[part] |= np.abs(out[part] - into[k]) <= into[k] * tolerance
        return counts, hit
    first = np.searchsorted(ascending, out, "left")
    hit = in_rectangles(
        place[when], np.searchsorted(times, out_ts - span, "right"), np.searchsorted(times, out_ts, "right"), np.searchsorted(most, first, "right"), np.searchsorted(least, first, "right")
    )
    return counts, hit > 0
