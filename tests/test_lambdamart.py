"""The boosted listwise ranker against plain loops, its Shapley values against all subsets, and its independence of how rows are dealt."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import lambdamart as L
from triagelake.operators import ranker as K
from triagelake.params import Boost

SHAPE = "alert_id string, subject_account string, period_start timestamp_ntz, feature_cutoff_ts timestamp_ntz, signal double, other double, noise double, same double, feature_version string"


def tables(spark, days=6, per_day=40, seed=2):
    r = np.random.default_rng(seed)
    rows, truth = [], []
    for day in range(days):
        for k in range(per_day):
            label = bool(r.random() < 0.25) and day != 2  # a day without positives
            start = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
            rows.append((f"{day:010d}{k:010d}", "s", start, start + dt.timedelta(days=1), float(r.normal() + 1.2 * label), float(round(r.normal() + label, 1)), float(r.normal() * 40), 7.0, "features-1"))
            truth.append((rows[-1][0], label))
    return spark.createDataFrame(rows, SHAPE), spark.createDataFrame(truth, "alert_id string, is_true_positive boolean"), rows, dict(truth)


def plain(days, boost, edges):
    """Trees and scores by loops over all pairs; days: for each period a list of (id, label, bins)."""
    score = [[0.0] * len(d) for d in days]
    trees = []
    for _ in range(boost.rounds):
        rows = []
        for d, s in zip(days, score):
            order = sorted(range(len(d)), key=lambda i: (-s[i], d[i][0]))
            disc = {i: 1 / math.log2(2 + r) if r < boost.truncation else 0.0 for r, i in enumerate(order)}
            good = sum(x[1] for x in d)
            best = sum(1 / math.log2(2 + r) for r in range(min(good, boost.truncation)))
            g, h = [0.0] * len(d), [0.0] * len(d)
            for i, j in itertools.product(range(len(d)), repeat=2):
                if d[i][1] and not d[j][1]:
                    p = 1 / (1 + math.exp(s[i] - s[j]))
                    w = abs(disc[i] - disc[j]) / best
                    g[i], g[j] = g[i] + p * w, g[j] - p * w
                    h[i], h[j] = h[i] + p * (1 - p) * w, h[j] + p * (1 - p) * w
            rows += [(x[2], a, b) for x, a, b in zip(d, g, h) if 0 < good < len(d)]
        tree = L.Tree()
        tree.add(0.0, len(rows))
        open_, leaves = {0: rows}, 1
        for _ in range(boost.depth):
            found = []
            for node, own in open_.items():
                part = lambda x: sum(r[1] for r in x) ** 2 / (sum(r[2] for r in x) + boost.l2)
                best = (1e-12,)
                for f, e in enumerate(edges):
                    for cut in range(len(e)):
                        a, b = [r for r in own if r[0][f] <= cut], [r for r in own if r[0][f] > cut]
                        if min(len(a), len(b)) >= boost.least_rows and part(a) + part(b) - part(own) > best[0] + 1e-9:
                            best = (part(a) + part(b) - part(own), f, cut, a, b)
                if len(best) > 1:
                    found.append((-best[0], node, *best[1:]))
            fresh = {}
            for gain, node, f, cut, a, b in sorted(found, key=lambda x: x[:2]):
                if leaves < boost.leaves:
                    made = [tree.add(boost.rate * sum(r[1] for r in x) / (sum(r[2] for r in x) + boost.l2), len(x)) for x in (a, b)]
                    tree.split(node, f, cut, -gain, *made)
                    fresh |= dict(zip(made, (a, b)))
                    leaves += 1
            open_ = fresh if leaves < boost.leaves else {}
        trees.append(tree)
        for d, s in zip(days, score):
            for i, x in enumerate(d):
                s[i] += tree.value[walk(tree, x[2])]
    return trees


def walk(tree, bins):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] if bins[tree.feature[node]] <= tree.cut[node] else tree.right[node]
    return node


@pytest.mark.parametrize("truncation, block", [(8, 7), (500, 4096)])
def test_equals_loops_over_all_pairs(spark, monkeypatch, truncation, block):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "SETTLE", 2)
    features, prepared, rows, truth = tables(spark)
    boost = Boost(rounds=5, leaves=5, rate=0.3, least_rows=4, truncation=truncation, depth=3, bins=16)
    got = L.lambdamart_models(features.repartition(5), prepared, "2024-01-03", boost)
    assert list(got) == [f"2024-01-0{d}" for d in range(3, 7)]
    ids = {r.alert_id: r.h for r in features.select("alert_id", F.xxhash64("alert_id").alias("h")).collect()}
    edges = got["2024-01-03"].edges
    early = np.array([r[4:8] for r in rows if r[2].day < 3])
    assert all(set(e) <= set(early[:, k]) for k, e in enumerate(edges))  # no bin knows of a later period
    for day, model in got.items():
        past = {}
        for r in rows:
            if str(r[2].date()) < day:
                past.setdefault(r[2], []).append((ids[r[0]], int(truth[r[0]]), tuple(int(np.searchsorted(e, x)) for e, x in zip(edges, r[4:8]))))
        for mine, theirs in zip(model.trees, plain(list(past.values()), boost, edges), strict=True):
            assert (mine.feature, mine.cut, mine.cover) == (theirs.feature, theirs.cut, theirs.cover)
            assert np.allclose(mine.value, theirs.value, atol=1e-6) and np.allclose(mine.gain, theirs.gain, atol=1e-5)
    gains = dict(got["2024-01-06"].importance())
    assert max(gains, key=gains.get) in ("signal", "other") and gains["same"] == 0
    assert sum(gains.values()) == pytest.approx(sum(sum(t.gain) for t in got["2024-01-06"].trees))


def test_models_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    features, prepared, _, _ = tables(spark, days=4)
    boost = Boost(rounds=4, leaves=6, least_rows=3, truncation=5, depth=3, bins=8)
    one = L.lambdamart_models(features, prepared, "2024-01-03", boost)
    monkeypatch.setattr(L, "TOGETHER", 1)
    two = L.lambdamart_models(features.repartition(7, "signal"), prepared.repartition(3), "2024-01-03", boost)
    assert {d: m.trees for d, m in one.items()} == {d: m.trees for d, m in two.items()} and len(one) == 2


def test_no_task_holds_a_period(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    features, prepared, rows, truth = tables(spark, days=2, per_day=100)
    packed = L._packed(
        features.select(F.to_date("period_start").cast("string").alias("day"), F.xxhash64("alert_id").alias("id"), F.lit(0).alias("label"), L._values(["signal"]).alias("x")),
        spark.createDataFrame([("2024-01-01", 100), ("2024-01-02", 100)], "day string, n long"), [np.array([0.0])], 4,
    )
    sizes = [len(r.labels) for r in packed.collect()]
    assert sum(sizes) == 200 and len(sizes) > 20 and max(sizes) < 24


def test_scores_walk_forward_stability_and_contributions(spark):
    features, prepared, rows, truth = tables(spark, days=7)
    models = L.lambdamart_models(features, prepared, "2024-01-02", Boost(rounds=6, leaves=6, least_rows=4, truncation=10, depth=3, bins=16))
    scores = {r.alert_id: r.score for r in K.walk_forward(features, models).collect()}
    assert len(scores) == 6 * 40
    x = {r[0]: (str(r[2].date()), np.array([r[4:8]])) for r in rows}
    assert all(s == pytest.approx(models[x[a][0]].values(x[a][1])[0]) for a, s in scores.items())
    last = features.where("to_date(period_start) = '2024-01-07'")
    model, parts = models["2024-01-07"], {}
    base = L.shapley(model.trees, np.zeros((1, 4), np.uint8))[1]
    for r in model.contributions(last, top=4).collect():
        parts.setdefault(r.alert_id, []).append(r)
    assert len(parts) == 40
    for a, found in parts.items():
        assert base + sum(r.contribution for r in found) == pytest.approx(scores[a])
        assert [(-abs(r.contribution), r.feature) for r in found] == sorted((-abs(r.contribution), r.feature) for r in found)
        assert all(r.value == dict(zip(("signal", "other", "noise", "same"), x[a][1][0]))[r.feature] for r in found)
    # a model of the 4th is the first with three periods behind it, so the pairs are of the 5th, 6th and 7th
    stable = {str(r.period_start.date()): r.rho for r in K.rank_stability(features, models).collect()}
    assert sorted(stable) == ["2024-01-05", "2024-01-06", "2024-01-07"]
    day = lambda d, of: [models[of].values(x[r[0]][1])[0] for r in rows if str(r[2].date()) == d]
    for d, before in (("2024-01-05", "2024-01-04"), ("2024-01-06", "2024-01-05"), ("2024-01-07", "2024-01-06")):
        assert stable[d] == pytest.approx(rank_correlation(day(d, before), day(d, d)))


def rank_correlation(a, b):
    rank = lambda v: np.array([(sum(x < y for x in v) + sum(x <= y for x in v) + 1) / 2 for y in v])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_linear_stability_pairs_successive_models_with_an_early_start(spark):
    features, prepared, rows, _ = tables(spark, days=7)
    models = K.pairwise_models(features, prepared, "2024-01-02")
    stable = {str(r.period_start.date()): r.rho for r in K.rank_stability(features, models).collect()}
    assert sorted(stable) == ["2024-01-05", "2024-01-06", "2024-01-07"]
    x = {d: np.array([r[4:8] for r in rows if str(r[2].date()) == d]) for d in stable}
    value = lambda m, v: ((v - np.array(m.mean)) / np.array(m.sd)) @ np.array(m.weights)
    for d, before in (("2024-01-05", "2024-01-04"), ("2024-01-06", "2024-01-05"), ("2024-01-07", "2024-01-06")):
        assert stable[d] == pytest.approx(rank_correlation(value(models[before], x[d]), value(models[d], x[d])))


@pytest.mark.parametrize("seed", range(3))
def test_shapley_values_are_those_of_all_subsets(seed):
    r = np.random.default_rng(seed)
    width = 8

    def random_tree():
        t = L.Tree()
        t.add(float(r.normal()), 1000)
        for node in range(9):
            if node < len(t.feature) and t.feature[node] < 0 and t.cover[node] > 3:
                n = int(r.integers(1, t.cover[node]))
                t.split(node, int(r.integers(width)), int(r.integers(0, 6)), 1.0, t.add(float(r.normal()), n), t.add(float(r.normal()), t.cover[node] - n))
        return t

    trees, bins = [random_tree() for _ in range(3)], r.integers(0, 8, (6, width)).astype(np.uint8)

    def expected(t, row, known, node=0):
        if t.feature[node] < 0:
            return t.value[node]
        a, b = t.left[node], t.right[node]
        if t.feature[node] in known:
            return expected(t, row, known, a if row[t.feature[node]] <= t.cut[node] else b)
        return (t.cover[a] * expected(t, row, known, a) + t.cover[b] * expected(t, row, known, b)) / t.cover[node]

    got, base = L.shapley(trees, bins)
    for k, row in enumerate(bins):
        total = {s: sum(expected(t, row, s) for t in trees) for n in range(width + 1) for s in itertools.combinations(range(width), n)}
        assert base == pytest.approx(total[()]) and base + got[k].sum() == pytest.approx(total[tuple(range(width))])
        for f in range(width):
            want = sum(
                math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) * (total[tuple(sorted((*s, f)))] - total[s]) for s in total if f not in s
            )
            assert got[k, f] == pytest.approx(want, abs=1e-9)


def test_outcomes_are_refused_and_days_without_pairs_have_no_model(spark):
    features, prepared, _, _ = tables(spark, days=3)
    with pytest.raises(ValueError, match="outcome"):
        L.lambdamart_models(features.withColumn("is_true_positive", F.lit(True)), prepared, "2024-01-02", Boost(rounds=1))
    assert L.lambdamart_models(features, prepared.withColumn("is_true_positive", F.lit(False)), "2024-01-02", Boost(rounds=1)) == {}
    assert L.lambdamart_models(features.limit(0), prepared, "2024-01-02", Boost(rounds=1)) == {}
    assert K.walk_forward(features, {}).count() == 0
