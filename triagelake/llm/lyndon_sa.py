"""Suffix arrays by linear grouping over Lyndon prefixes, for many strings at once.

Phase one keeps suffixes in groups that share a prefix, sorted within their string, and takes the groups in
descending order.  The suffixes of the taken group have their longest Lyndon prefix; each hands it to the nearest
earlier suffix of a smaller group (its previous-smaller pointer), which by the number of copies it receives moves
to a higher group.  Phase two takes the finished groups in ascending order and emits each group's order: behind
their common Lyndon prefix two members compare as suffixes whose places are known already.  Nothing is renamed
and nothing recurses.  Strings are independent, so each round takes one group of every string in numpy.
"""

from __future__ import annotations

import numpy as np

from triagelake.llm.common import ragged


def _chase(at: np.ndarray, floor: np.ndarray, own: np.ndarray, grp: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """Previous-smaller pointers of the members at of one group a string; own: the group's start."""
    p = at - 1
    p[p < floor] = -1
    prev[at] = p
    live = np.flatnonzero(p >= 0)
    live = live[grp[p[live]] >= own[live]]
    while len(live):
        p[live] = prev[p[live]]  # of a finished suffix its pointer, of a member its pointer so far
        prev[at[live]] = p[live]
        live = live[p[live] >= 0]
        live = live[grp[p[live]] >= own[live]]
    return p


def suffix_arrays(sym: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings sym[begin[k]:begin[k + 1]], each ending on a symbol smaller than all its others.

    Positions are those in sym; string k's array is at begin[k] to begin[k + 1].
    """
    n, size = len(sym), np.diff(begin)
    text = np.repeat(np.arange(len(size)), size)
    key = text * (int(sym.max()) + 1) + sym
    sa = np.argsort(key, kind="stable")
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    sorted_key = key[sa]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    heads = np.flatnonzero(head)
    grp = np.empty(n, np.int64)
    grp[sa] = heads[np.cumsum(head) - 1]
    width, lyn = np.zeros(n, np.int64), np.ones(n, np.int64)  # of groups, at their starts
    width[heads] = np.diff(np.append(heads, n))
    prev = np.full(n, -1)
    moved = np.zeros(n, bool)
    floor, cur = begin[:-1].copy(), begin[1:].copy()
    active = np.flatnonzero(size > 0)
    while len(active):
        g = grp[sa[cur[active] - 1]]
        count = cur[active] - g
        at = sa[ragged(g, count)]
        p = _chase(at, np.repeat(floor[active], count), np.repeat(g, count), grp, prev)
        own = np.repeat(lyn[g], count)
        ok = p >= 0
        p, own = p[ok], own[ok]
        if len(p):
            order = np.argsort(p)
            p, own = p[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            u, copies, own = p[first], np.diff(np.append(first, len(p))), own[first]
            h = grp[u]
            order = np.lexsort((copies, h))
            u, copies, own, h = u[order], copies[order], own[order], h[order]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            at_h = np.flatnonzero(new_h)
            k = np.diff(np.append(at_h, len(h)))
            each = np.cumsum(new_h) - 1
            tail = (h[at_h] + width[h[at_h]] - k)[each]
            dest = tail + np.arange(len(h)) - at_h[each]
            moved[u] = True
            held = sa[dest]
            out = held[~moved[held]]
            hole = isa[u][isa[u] < tail]
            sa[hole], isa[out] = out, hole
            sa[dest], isa[u] = u, dest
            moved[u] = False
            split = new_h | np.concatenate([[True], copies[1:] != copies[:-1]])
            s = np.flatnonzero(split)
            start = dest[s]
            long = lyn[h[s]] + copies[s] * own[s]
            width[h[at_h]] -= k
            width[start] = np.diff(np.append(s, len(h)))
            lyn[start] = long
            grp[u] = np.repeat(start, np.diff(np.append(s, len(h))))
        cur[active] = g
        active = active[g > floor[active]]
    # phase two
    rank = np.zeros(n, np.int64)
    cur = begin[:-1].copy()
    active = np.flatnonzero(size > 0)
    while len(active):
        g = cur[active]

        count = width[g]
        at = sa[ragged(g, count)]
        if (count > 1).any():
            own, step = np.repeat(g, count), np.repeat(lyn[g], count)
            nxt = at + step
            chain = np.zeros(len(at), np.int64)
            live = np.flatnonzero(nxt < n)
            live = live[grp[nxt[live]] == own[live]]
            while len(live):
                chain[live] += 1
                nxt[live] += step[live]
                live = live[nxt[live] < n]
                live = live[grp[nxt[live]] == own[live]]
            order = np.lexsort((rank[np.minimum(nxt, n - 1)], chain, own))
            at = at[order]
            sa[ragged(g, count)] = at
        rank[at] = ragged(g, count)
        cur[active] = g + count
        active = active[g + count < begin[active + 1]]
    return sa
