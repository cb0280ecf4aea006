"""The learned ordering, trained walk-forward on earlier periods only.

The boosted listwise ranker is in ``lambdamart``.  ``pairwise_models`` fits a linear order on the pairs of a positive and
a negative alert within each period (a period is a group), for every evaluation period from one pass: tasks add up each
period's second moments, and a model comes from the sums of the periods before it.  ``ridge_models`` is the pointwise
form of the same pass.
``LogisticRanker`` is pointwise on standardised features, ``TreeRanker`` uses boosted trees; either is refitted for
every period (``models``), so that loop runs on the driver and each fit is some Spark jobs.  Linear contributions
are exact (weight times standardised value).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import lambdamart
from triagelake.operators.features import KEYS, feature_columns


class Ranker(Protocol):
    def fit(self, train: DataFrame, names: list[str]) -> Ranker: ...

    def score(self, rows: DataFrame) -> DataFrame: ...

    def importance(self) -> list[tuple[str, float]]: ...


class LogisticRanker:
    def __init__(self, reg: float = 0.01, iterations: int = 40):
        self.reg, self.iterations = reg, iterations

    def fit(self, train: DataFrame, names: list[str]) -> LogisticRanker:
        self.names = names
        self.assemble = VectorAssembler(inputCols=names, outputCol="raw")
        made = self.assemble.transform(train)
        self.scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(made)
        self.model = LogisticRegression(featuresCol="x", labelCol="label", regParam=self.reg, maxIter=self.iterations).fit(self.scale.transform(made))
        self.weights = [float(w) for w in self.model.coefficients]
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self.scale.transform(self.assemble.transform(rows)))
        return out.select("alert_id", "period_start", F.element_at(vector_to_array("rawPrediction"), 2).alias("score"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(((n, abs(w)) for n, w in zip(self.names, self.weights)), key=lambda x: (-x[1], x[0]))

    def contributions(self, rows: DataFrame, top: int = 5) -> DataFrame:
        """(alert_id, feature, contribution): the top additive parts of each score; ties by feature name."""
        x = vector_to_array("x")
        parts = F.array(*[F.struct((-F.abs(x[i] * w)).alias("k"), F.lit(n).alias("feature"), (x[i] * w).alias("contribution")) for i, (n, w) in enumerate(zip(self.names, self.weights))])
        made = self.scale.transform(self.assemble.transform(rows))
        return made.select("alert_id", F.explode(F.slice(F.array_sort(parts), 1, top)).alias("p")).select("alert_id", "p.feature", "p.contribution")


class TreeRanker:
    def __init__(self, rounds: int = 20, depth: int = 4, seed: int = 1):
        self.rounds, self.depth, self.seed = rounds, depth, seed

    def fit(self, train: DataFrame, names: list[str]) -> TreeRanker:
        self.names = names
        self.assemble = VectorAssembler(inputCols=names, outputCol="x")
        self.model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed).fit(self.assemble.transform(train))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(self.assemble.transform(rows))
        return out.select("alert_id", "period_start", F.element_at(vector_to_array("rawPrediction"), 2).alias("score"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.names, map(float, self.model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


class RidgeRanker:
    """A fitted ridge regression on standardised features."""

    def __init__(self, names: list[str], weights: np.ndarray, mean: np.ndarray, sd: np.ndarray):
        self.names, self.weights = names, weights.tolist()
        self.mean, self.sd = mean.tolist(), sd.tolist()

    def _values(self) -> list:
        return [(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - m) / s for n, m, s in zip(self.names, self.mean, self.sd)]

    def score(self, rows: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for x, w in zip(self._values(), self.weights):
            total = total + x * w
        return rows.select("alert_id", "period_start", total.alias("score"))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(((n, abs(w)) for n, w in zip(self.names, self.weights)), key=lambda x: (-x[1], x[0]))

    def contributions(self, rows: DataFrame, top: int = 5) -> DataFrame:
        """(alert_id, feature, value, contribution): the top additive parts of each score; ties by feature name."""
        parts = F.array(*[
            F.struct((-F.abs(x * w)).alias("k"), F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"), (x * w).alias("contribution"))
            for x, n, w in zip(self._values(), self.names, self.weights)
        ])
        return rows.select("alert_id", F.explode(F.slice(F.array_sort(parts), 1, top)).alias("p")).select("alert_id", "p.feature", "p.value", "p.contribution")


class PairwiseRanker(RidgeRanker):
    """A linear order fitted on pairs of a positive and a negative alert of one period (one group a period).

    The loss of a pair is (1 - (score of the positive - score of the negative)) squared, with a ridge penalty.
    ``gains`` are the features' parts of the loss that the fit takes off; they add up to all of it.
    """

    def __init__(self, names: list[str], weights: np.ndarray, mean: np.ndarray, sd: np.ndarray, gains: np.ndarray, pairs: float):
        super().__init__(names, weights, mean, sd)
        self.gains, self.pairs = gains.tolist(), float(pairs)

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.names, self.gains), key=lambda x: (-x[1], x[0]))


def _no_outcomes(features: DataFrame) -> None:
    if {"is_true_positive", "attempt_ids", "laundering_transactions"} & set(features.columns) or any("aunder" in c for c in features.columns):
        raise ValueError("outcome column among the features")


def _moments(features: DataFrame, prepared: DataFrame, names: list[str]) -> DataFrame:
    """(day, label, m): sums of products of (1, features) for each period and outcome, added up in the tasks first."""
    known = prepared.select("alert_id", F.col("is_true_positive").cast("int").alias("label"))
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    rows = features.join(known, "alert_id").select(F.to_date("period_start").cast("string").alias("day"), "label", x.alias("x"))
    size = len(names) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            z = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for g in set(group):
                of = z[[k for k, x in enumerate(group) if x == g]]
                sums[g] = sums.get(g, 0) + of.T @ of
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in sums], pa.string()), pa.array([y for _, y in sums], pa.int32()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], names=["day", "label", "m"]
        )

    def total(t: pa.Table) -> pa.Table:
        m = np.array(t.column("m").to_pylist()).sum(axis=0)
        return pa.table([t.column("day").slice(0, 1), t.column("label").slice(0, 1), pa.array([m.tolist()], pa.list_(pa.float64()))], names=["day", "label", "m"])

    shape = "day string, label int, m array<double>"
    return rows.mapInArrow(partial, shape).groupBy("day", "label").applyInArrow(total, shape)


def _by_day(features: DataFrame, prepared: DataFrame) -> tuple[list[str], list[tuple[str, np.ndarray, np.ndarray]]]:
    """Feature names, and each day's matrices of negatives and of positives, in order of days.

    What comes to the driver is two matrices of features by features for each period.
    """
    _no_outcomes(features)
    names = feature_columns(features)
    size = len(names) + 1
    days: dict[str, dict[int, np.ndarray]] = {}
    for row in _moments(features, prepared, names).collect():
        days.setdefault(row.day, {})[row.label] = np.array(row.m).reshape(size, size)
    none = np.zeros((size, size))
    return names, [(d, m.get(0, none), m.get(1, none)) for d, m in sorted(days.items())]


def _spread(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, standard deviation (1 where constant) and which features are constant, of a matrix of moments."""
    n = total[0, 0]
    mean = total[0, 1:] / n
    sd = np.sqrt(np.maximum(np.diag(total)[1:] / n - mean * mean, 0))
    flat = sd <= 1e-9 * np.maximum(np.abs(mean), 1)
    sd[flat] = 1.0
    return mean, sd, flat


def ridge_models(features: DataFrame, prepared: DataFrame, start: str, reg: float = 0.01) -> dict[str, RidgeRanker]:
    """One pointwise model for each evaluation day, from the moments of the periods before; days without both labels have none."""
    names, days = _by_day(features, prepared)
    total, hits, out = 0, 0, {}
    for day, bad, good in days:
        if day >= start and np.ndim(total) and 0 < hits[0, 0] < total[0, 0]:
            n = total[0, 0]
            mean, sd, flat = _spread(total)
            corr = (total[1:, 1:] / n - np.outer(mean, mean)) / np.outer(sd, sd)
            corr[flat], corr[:, flat] = 0, 0
            with_label = (hits[0, 1:] / n - mean * hits[0, 0] / n) / sd
            with_label[flat] = 0
            out[day] = RidgeRanker(names, np.linalg.solve(corr + reg * np.eye(len(names)), with_label), mean, sd)
        total, hits = total + bad + good, hits + good
    return out


def pairwise_models(features: DataFrame, prepared: DataFrame, start: str, reg: float = 0.01) -> dict[str, PairwiseRanker]:
    """One pairwise model for each evaluation day, from all pairs within the periods before; days without a pair have none.

    The pairs are never formed.  With N, s, M the number, sum and sum of outer products of a period's positives (p)
    and negatives (n), its pairs' differences have the outer products N_n M_p + N_p M_n - s_p s_n' - s_n s_p' and the sum
    N_n s_p - N_p s_n.
    """
    names, days = _by_day(features, prepared)
    size = len(names)
    total, outer, diff, pairs, out = 0, np.zeros((size, size)), np.zeros(size), 0.0, {}
    for day, bad, good in days:
        if day >= start and pairs > 0:
            mean, sd, flat = _spread(total)
            left, right = outer / pairs / np.outer(sd, sd), diff / pairs / sd
            left[flat], left[:, flat], right[flat] = 0, 0, 0
            w = np.linalg.solve(left + reg * np.eye(size), right)
            out[day] = PairwiseRanker(names, w, mean, sd, w * right, pairs)
        np_, nn, sp, sn = good[0, 0], bad[0, 0], good[0, 1:], bad[0, 1:]
        outer = outer + nn * good[1:, 1:] + np_ * bad[1:, 1:] - np.outer(sp, sn) - np.outer(sn, sp)
        diff, pairs, total = diff + nn * sp - np_ * sn, pairs + np_ * nn, total + bad + good
    return out


def _all_of_one_kind(fitted: dict[str, Ranker]) -> bool:
    """Whether one job can score all days: linear models are joined to their rows, boosted ones are broadcast together."""
    return bool(fitted) and any(all(isinstance(m, kind) for m in fitted.values()) for kind in (RidgeRanker, lambdamart.LambdaMart))


def _scored(features: DataFrame, by_day: dict[str, Ranker], name: str) -> DataFrame:
    """features' keys with the score of the model of each row's day: for linear models one join to a table of one row a period."""
    if isinstance(next(iter(by_day.values())), lambdamart.LambdaMart):
        return lambdamart.scored(features, by_day, name)
    spark = features.sparkSession
    rows = [(d, [w / s for w, s in zip(m.weights, m.sd)], float(-sum(w * a / s for w, a, s in zip(m.weights, m.mean, m.sd)))) for d, m in by_day.items()]
    table = spark.createDataFrame(rows, "day string, w array<double>, b double")
    names = next(iter(by_day.values())).names
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    dot = F.aggregate(F.zip_with(x, F.col("w"), lambda a, b: a * b), F.col("b"), lambda a, b: a + b)
    day = F.to_date("period_start").cast("string")
    return features.withColumn("day", day).join(F.broadcast(table), "day").select("alert_id", "period_start", dot.alias(name))


def training_frame(features: DataFrame, prepared: DataFrame, before: str) -> DataFrame:
    """Features with label of periods strictly before a day. Refuses outcome columns among the features."""
    _no_outcomes(features)
    known = prepared.select("alert_id", F.col("is_true_positive").cast("double").alias("label"))
    return features.join(known, "alert_id").where(F.to_date("period_start") < F.lit(before).cast("date"))


def ranking_groups(features: DataFrame, prepared: DataFrame, before: str) -> DataFrame:
    """(period_start, alerts, positives, pairs): the groups that a model of a day is trained on, one a period."""
    rows = training_frame(features, prepared, before).groupBy("period_start").agg(F.count("*").alias("alerts"), F.sum("label").cast("long").alias("positives"))
    return rows.withColumn("pairs", F.col("positives") * (F.col("alerts") - F.col("positives")))


def _periods(features: DataFrame, start: str) -> list[str]:
    """Evaluation days, one row a period."""
    days = features.select(F.to_date("period_start").alias("d")).distinct().where(F.col("d") >= F.lit(start).cast("date"))
    return [str(r.d) for r in days.orderBy("d").collect()]


def models(features: DataFrame, prepared: DataFrame, start: str, make=LogisticRanker) -> dict[str, Ranker]:
    """One model for each evaluation day, fitted once and shared by scoring and stability."""
    names = feature_columns(features)
    out = {}
    for day in _periods(features, start):
        train = training_frame(features, prepared, day).cache()
        if train.select("label").distinct().count() == 2:
            out[day] = make().fit(train, names)
        train.unpersist()
    return out


def walk_forward(features: DataFrame, fitted: dict[str, Ranker]) -> DataFrame:
    """(alert_id, period_start, score), each period scored by the model of the periods before it."""
    if _all_of_one_kind(fitted):
        return _scored(features, fitted, "score")
    out = None
    for day, model in fitted.items():
        part = model.score(features.where(F.to_date("period_start") == F.lit(day).cast("date")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = features.select("alert_id", "period_start", F.lit(0.0).alias("score")).limit(0)
    return out


def rank_stability(features: DataFrame, fitted: dict[str, Ranker], least: int = 3) -> DataFrame:
    """Per period the rank correlation of the scores of two successive models.

    The first period has none, nor has one whose earlier model had fewer than least training periods.
    """
    from triagelake.operators.backtest import spearman

    before = [str(r.d) for r in features.select(F.to_date("period_start").alias("d")).distinct().orderBy("d").collect()]  # one row a period
    trained = [d for d in fitted if sum(x < d for x in before) >= least]
    days, out = trained, None  # a model with enough periods behind it is followed by such models only
    if len(days) > 1 and _all_of_one_kind(fitted):
        now = _scored(features, {d: fitted[d] for d in days[1:]}, "b")
        then = _scored(features, dict(zip(days[1:], (fitted[d] for d in days[:-1]))), "a")
        return spearman(now.join(then, ["alert_id", "period_start"]), "a", "b", "period_start")
    for before, day in zip(days[:-1], days[1:]):
        rows = features.where(F.to_date("period_start") == F.lit(day).cast("date"))
        both = fitted[before].score(rows).select("alert_id", "period_start", F.col("score").alias("a")).join(fitted[day].score(rows).select("alert_id", F.col("score").alias("b")), "alert_id")
        out = both if out is None else out.unionByName(both)
    if out is None:
        return features.select("period_start", F.lit(0.0).alias("rho")).limit(0)
    return spearman(out, "a", "b", "period_start")


__all__ = ["KEYS", "LogisticRanker", "PairwiseRanker", "Ranker", "RidgeRanker", "TreeRanker", "models", "pairwise_models", "rank_stability", "ranking_groups", "ridge_models", "training_frame", "walk_forward"]
