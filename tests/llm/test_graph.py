"""Components against union-find, on chains, stars and random graphs; the plan must not grow with the rounds."""

import random

import numpy as np
import pytest

from triagelake.llm import graph, simhash_dedup


def union_find(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(up)}


def run(spark, edges):
    out = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    return {r.node: r.root for r in out.collect()}


def chain(n):
    return [(k, k + 1) for k in range(n - 1)]


def random_graph(seed, nodes, edges):
    r = random.Random(seed)
    return [(r.randrange(-nodes, nodes), r.randrange(-nodes, nodes)) for _ in range(edges)]


@pytest.mark.parametrize("edges", [
    chain(200), [(b, a) for a, b in chain(60)][::-1], [(7, k) for k in range(100, 400)], random_graph(1, 100, 90), random_graph(2, 300, 500),
    [(-(2**63), 2**63 - 1), (2**63 - 1, 0)],
], ids=["chain", "falling chain", "star", "sparse", "dense", "extremes"])
def test_components_are_those_of_union_find(spark, edges):
    want = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert run(spark, edges) == want


def test_no_edges_and_loops_give_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(3, 3)]) == {}


def test_a_template_that_drifts_two_bits_at_a_time_is_one_component(spark):
    prints = [(1 << 2 * k) - 1 for k in range(33)]
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    pairs = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2)
    roots = graph.components(pairs).collect()
    assert {r.node for r in roots} == set(signed) and len({r.root for r in roots}) == 1


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash_dedup.links(spark.createDataFrame([(1,)], "fp long"), 3)
