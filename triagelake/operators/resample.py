"""Bootstrap intervals by reproducible draws: draw d of sample s picks element hash(seed, s, d) mod n.

``poisson_mean`` is for groups of any size; the others hold a group's outcomes, which the operating point bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from triagelake.functions import draw


def _percentiles(samples: DataFrame, value: str, confidence: float, by: list[str]) -> DataFrame:
    tail = (1 - confidence) / 2
    order = F.sort_array(F.collect_list(value))
    at = lambda q: F.element_at(order, (F.floor(F.lit(q) * (F.count(value) - 1)) + 1).cast("int"))
    return samples.groupBy(*by).agg(F.count(value).alias("samples"), at(tail).alias("low"), at(1 - tail).alias("high"))


def bootstrap_mean(outcomes: DataFrame, by: str, key: list[str], value: str, n: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Per group the mean of a 0/1 outcome and its percentile interval over n resamples.

    A group's outcomes, in order, are one array: at most K for each period, which the operating point bounds.  Samples
    are dealt to all tasks, and each adds up its own draws from the array, so nothing is joined.
    """
    one = F.col(value).cast("int")
    rows = outcomes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*key, one.alias("_v")))).alias("o")).select(by, F.transform("o", lambda x: x["_v"]).alias("o"))
    parts = int(outcomes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples = rows.select(by, "o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")).repartition(parts, by, "s")
    size = F.size("o")
    hits = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, d: a + F.get("o", (draw(F.lit(str(seed)), F.col("s"), d) % size).cast("int")))
    means = samples.select(by, (hits / size).alias("m"))
    point = rows.select(by, (F.aggregate("o", F.lit(0), lambda a, x: a + x) / size).alias("mean"))
    return point.join(_percentiles(means, "m", confidence, [by]), by)


def bootstrap_lift(per_period: DataFrame, top: str, base: str, n: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Interval of the ratio of two rungs' pooled precisions over resampled periods, both rungs paired.

    All periods' four counts are one array, a few numbers for each period.  Samples without a hit below are left out.
    """
    counts = [F.coalesce(F.sum(F.when(F.col("rung") == r, F.col(c))), F.lit(0)).cast("double").alias(f"{side}_{c}") for side, r in (("top", top), ("base", base)) for c in ("worked", "true_positives")]
    wide = per_period.groupBy("period_start").agg(*counts)
    names = [f"{side}_{c}" for side in ("top", "base") for c in ("worked", "true_positives")]
    rows = wide.agg(F.array_sort(F.collect_list(F.struct("period_start", *names))).alias("o"))
    size = F.size("o")
    samples = rows.select("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s")).where(size > 0)
    picked = F.transform(F.sequence(F.lit(0), size - 1), lambda d: F.get("o", (draw(F.lit(str(seed)), F.col("s"), d) % size).cast("int")))
    total = lambda c: F.aggregate("p", F.lit(0.0), lambda a, x: a + x[c]).alias(c)
    sums = samples.select(picked.alias("p")).select(*map(total, names))
    ratio = F.try_divide(F.try_divide("top_true_positives", "top_worked"), F.try_divide("base_true_positives", "base_worked"))
    return _percentiles(sums.select(ratio.alias("m")), "m", confidence, [])


def poisson_mean(outcomes: DataFrame, by: str, key: list[str], value: str, n: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Per group the mean of a number and its percentile interval over n resamples, for groups of any size.

    Each row takes part in each resample as often as a Poisson number of mean 1 says, drawn from the hash of its key and
    the seed, so a row's draws do not depend on the task that it is in.  Tasks hold two sums a group and resample, and
    nothing else; of large groups this is the bootstrap with the resample's size left free.
    """
    kind = outcomes.schema[by].dataType.simpleString()
    names = [by, "_sums"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for group, h, x in rows:
                times = np.random.Generator(np.random.Philox(key=h & (2**64 - 1))).poisson(1.0, n)
                own = sums.setdefault(group, np.zeros((2, n + 1)))
                own[0, 1:] += times
                own[1, 1:] += times * x
                own[:, 0] += (1, x)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch_type), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=names)

    def total(t: pa.Table) -> pa.Table:
        count, mass = sum(np.frombuffer(b).reshape(2, -1) for b in t.column("_sums").to_pylist())
        means = np.sort((mass[1:] / np.maximum(count[1:], 1))[count[1:] > 0])
        tail = (1 - confidence) / 2
        at = [int(q * (len(means) - 1)) for q in (tail, 1 - tail)] if len(means) else []
        low, high = (float(means[k]) for k in at) if at else (None, None)
        made = {"mean": mass[0] / count[0], "samples": len(means), "low": low, "high": high}
        return pa.table({by: t.column(by).slice(0, 1), **{k: [v] for k, v in made.items()}})

    batch_type = to_arrow_type(outcomes.schema[by].dataType)
    rows = outcomes.where(F.col(value).isNotNull()).select(by, F.xxhash64(F.lit(seed), *key).alias("h"), F.col(value).cast("double").alias("x"))
    return rows.mapInArrow(partial, f"`{by}` {kind}, _sums binary").groupBy(by).applyInArrow(total, f"`{by}` {kind}, mean double, samples long, low double, high double")
