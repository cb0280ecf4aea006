"""Hard negatives against brute force: ties, repeats, unusable rows, unequal and wide vectors, chunks of anchors."""

import math

import numpy as np
import pytest

from triagelake.llm import hard_negatives as H

SHAPE = "vec_id long, label int, embedding array<double>, score string"


def brute(rows, anchors, positives=5, negatives=3):
    def usable(rows):
        ok = [r for r in rows if None not in r[:3] and all(x is not None and math.isfinite(x) for x in r[2])]
        return [(i, y, tuple(math.floor(256.0 * x) for x in v)) for i, y, v, *_ in ok]

    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
    out, rows = set(), usable(rows)
    for i, y, v in set(usable(anchors)):
        scored = {(-dot(v, w), j, z == y) for j, z, w in rows}
        for s, j, _ in sorted(x for x in scored if x[2] and x[1] != i)[:positives]:
            fits = sorted(x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)
            for rank, (t, k, _) in enumerate(fits[:negatives], 1):
                out.add((i, j, rank, k, -s, -t))
    return out


def vectors(seed, n=400, d=16, wide=0.0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = (r.normal(size=d) * 0.3 + 0.2).tolist()
        if r.random() < wide:
            v[int(r.integers(d))] = float(r.choice([1e30, -5e4, 4096.0, -4096.01]))
        rows.append((i, int(r.integers(0, 4)), v, "s"))
    same = rows[7][2]
    return rows + [(1000 + k, 1, same, "s") for k in range(60)] + [(1000, 1, same, "s"), (7, rows[7][1], same, "s")]  # one very common vector, and repeated rows


ODD = [(None, 1, [0.5] * 16, "s"), (2000, None, [0.5] * 16, "s"), (2001, 1, None, "s"), (2002, 1, [0.5, None], "s"), (2003, 1, [float("nan")] * 16, "s"), (2004, 1, [float("inf")] * 16, "s")]
RAGGED = [(2010, 1, [], "s"), (2011, 2, [1.0] * 3, "s"), (2012, 3, [0.7] * 40, "s"), (2013, 1, [0.6] * 40, "s")]


@pytest.mark.parametrize("seed, wide, more", [(1, 0.0, ODD), (2, 0.0, RAGGED), (3, 0.05, ODD + RAGGED)])
def test_equals_brute_force(spark, monkeypatch, seed, wide, more):
    monkeypatch.setattr(H, "FIRST_ROWS", 16)
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "ANCHORS", 8)
    rows = vectors(seed, wide=wide) + more
    anchors = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] in (7, 2010, 2012, 2013))]
    both = [spark.createDataFrame(x, SHAPE) for x in (rows, anchors)]
    want = brute(rows, anchors)
    got = [tuple(r) for r in H.hard_negatives(both[0].repartition(3), both[1]).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    monkeypatch.setattr(H, "CHUNK_BYTES", 500)
    assert {tuple(r) for r in H.hard_negatives(both[0], both[1]).collect()} == want


def test_planes_drop_pairs_and_keep_all_that_qualify():
    r = np.random.default_rng(5)
    q, a = r.integers(-200, 200, (300, 24)).astype(float), r.integers(-200, 200, (40, 24)).astype(float)
    exact = (q @ a.T).astype(np.int64)
    least, most = np.full(40, 60_000.0), np.full(40, 90_000.0)
    least[0], most[1] = -np.inf, -np.inf
    alive = r.random((300, 40)) < 0.7
    x, y, s = H.surviving(H.Planes(q), a, alive, least, most)
    assert {*zip(x.tolist(), y.tolist())} == {*zip(*(v.tolist() for v in np.nonzero(alive & (exact >= least) & (exact <= most))))}
    assert (s == exact[x, y]).all()


def test_no_rows_from_nothing(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert H.hard_negatives(empty, empty).collect() == []
    one = spark.createDataFrame([(0, 1, [1.0], "s"), (1, 2, [1.0], "s")], SHAPE)
    assert H.hard_negatives(one, one).collect() == []  # no positives
    zero = spark.createDataFrame([(0, 1, [0.0], "s"), (1, 1, [1.0], "s"), (2, 2, [3.0], "s"), (3, 1, [-1.0], "s")], SHAPE)
    assert {tuple(r) for r in H.hard_negatives(zero, zero.where("vec_id = 0")).collect()} == {(0, 1, 1, 2, 0, 0), (0, 3, 1, 2, 0, 0)}
