"""The Poisson bootstrap against numpy's and the array form, and its independence of how rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import resample


def outcomes(spark, n=1500):
    r = np.random.default_rng(3)
    rows = [(str(g), k, bool(r.random() < p), float(r.normal(5, 2))) for k in range(n) for g, p in (("a", 0.3), ("b", 0.05))]
    return spark.createDataFrame(rows, "g string, id long, hit boolean, x double"), rows


def test_interval_is_that_of_the_other_bootstraps(spark):
    df, rows = outcomes(spark)
    got = {r.g: r for r in resample.poisson_mean(df.repartition(5), "g", ["g", "id"], "hit", 1000, 7).collect()}
    array = {r.g: r for r in resample.bootstrap_mean(df, "g", ["id"], "hit", 300, 7).collect()}
    for g in "ab":
        hits = np.array([r[2] for r in rows if r[0] == g], float)
        spread = hits.std() / np.sqrt(len(hits))
        assert got[g].mean == pytest.approx(hits.mean()) and got[g].samples == 1000
        for edge, sign in (("low", -1), ("high", 1)):
            assert abs(got[g][edge] - (hits.mean() + sign * 1.96 * spread)) < 0.35 * spread
            assert abs(got[g][edge] - array[g][edge]) < 0.6 * spread
    x = resample.poisson_mean(df.where("g = 'a'"), "g", ["id"], "x", 500, 1).first()
    assert x.low < 5.0 < x.high and x.high - x.low == pytest.approx(2 * 1.96 * 2 / np.sqrt(1500), rel=0.2)


def test_draws_do_not_depend_on_the_tasks_and_odd_groups_have_results(spark):
    df, _ = outcomes(spark, 100)
    one, two = (sorted(map(tuple, resample.poisson_mean(d, "g", ["id"], "hit", 50, 2).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert [x[:1] + x[2:3] for x in one] == [x[:1] + x[2:3] for x in two] and np.allclose([x[3:] for x in one], [x[3:] for x in two])
    single = spark.createDataFrame([("s", 1, 1.0), ("t", 2, None), (None, 3, 0.0)], "g string, id long, x double")
    got = {r.g: r for r in resample.poisson_mean(single, "g", ["id"], "x", 100).collect()}
    assert set(got) == {"s", None} and (got["s"].low, got["s"].high) == (1.0, 1.0) and 40 < got["s"].samples < 90
    assert resample.poisson_mean(single.limit(0), "g", ["id"], "x", 10).count() == 0


def test_equals_numpy_from_the_same_draws(spark):
    df, rows = outcomes(spark, 60)
    h = {r.id: r.h for r in df.where("g = 'a'").select("id", F.xxhash64(F.lit(9), "id").alias("h")).collect()}
    times = np.array([np.random.Generator(np.random.Philox(key=h[r[1]] & (2**64 - 1))).poisson(1.0, 200) for r in rows if r[0] == "a"])
    x = np.array([r[2] for r in rows if r[0] == "a"], float)
    means = np.sort(times.T @ x / times.sum(axis=0))
    got = resample.poisson_mean(df.where("g = 'a'"), "g", ["id"], "hit", 200, 9).first()
    assert (got.low, got.high) == (pytest.approx(means[int(0.025 * 199)]), pytest.approx(means[int(0.975 * 199)]))
