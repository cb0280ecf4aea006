"""Outcome join, review orderings and the metrics of a backtest.

Only this module reads outcome labels.  All orderings are total: every one ends on the alert id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import draw
from triagelake.operators import ordering
from triagelake.params import RULE_SUPPORT, RULES, TYPOLOGIES, OperatingPoint

LADDER = ("B0", "B1", "B2", "B3")


# ---- outcomes


def alert_facts(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """(alert_id, first_txn_ts, alert_amount) over the contributing transactions, currencies mixed on purpose."""
    ids = alerts.select("alert_id", F.explode_outer("contributing_txn_ids").alias("txn_id"))
    both = ids.join(txns.select("txn_id", "ts", "amount"), "txn_id", "left")
    return both.groupBy("alert_id").agg(F.min("ts").alias("first_txn_ts"), F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("alert_amount"))


def label_alerts(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Flagged transactions, attempts and typologies of each alert; a transaction of two attempts counts twice."""
    ids = alerts.select("alert_id", F.explode("contributing_txn_ids").alias("txn_id"))
    hits = ids.join(labels.drop("period"), "txn_id").groupBy("alert_id").agg(
        F.count("*").alias("laundering_transactions"), F.array_sort(F.collect_set("attempt_id")).alias("attempt_ids"), F.array_sort(F.collect_set("typology")).alias("typologies")
    )
    n = F.coalesce("laundering_transactions", F.lit(0))
    attempts = F.coalesce("attempt_ids", F.array().cast("array<bigint>"))
    return alerts.select("alert_id", "subject_account", "period_start", "fired_rules").join(hits, "alert_id", "left").select(
        "alert_id", "subject_account", "period_start", "fired_rules", n.alias("laundering_transactions"), attempts.alias("attempt_ids"),
        F.coalesce("typologies", F.array().cast("array<string>")).alias("typologies"), (n > 0).alias("is_true_positive"), ((n > 0) & (F.size(attempts) == 0)).alias("unattributed_only"),
    )


def prepare(alerts: DataFrame, txns: DataFrame, labels: DataFrame) -> DataFrame:
    return label_alerts(alerts, labels).join(alert_facts(alerts, txns), "alert_id", "left")


def evaluated(df: DataFrame, point: OperatingPoint) -> DataFrame:
    return df.where(F.col("period_start") >= F.lit(point.evaluation_start).cast("date").cast("timestamp_ntz"))


def evaluation_periods(prepared: DataFrame, point: OperatingPoint) -> DataFrame:
    return evaluated(prepared, point).select("period_start").distinct()


def population_base_rate(prepared: DataFrame, point: OperatingPoint) -> DataFrame:
    one = F.col("is_true_positive").cast("int")
    return evaluated(prepared, point).agg(F.count("*").alias("alerts"), F.coalesce(F.sum(one), F.lit(0)).alias("true_positives"), F.avg(one.cast("double")).alias("base_rate"))


# ---- orderings


def rule_hit_rates(prepared: DataFrame, weight: float) -> DataFrame:
    """(period_start, rule_id, alerts, hits, observed, pooled, hit_rate) from strictly earlier periods.

    One pass: counts per (period, rule) on a full spine, then running sums that stop before the period.
    """
    spark = prepared.sparkSession
    catalogue = spark.createDataFrame([(r,) for r in RULES], "rule_id string")
    spine = prepared.select("period_start").distinct().crossJoin(F.broadcast(catalogue))  # eight rules
    daily = prepared.select("period_start", F.explode("fired_rules").alias("rule_id"), F.col("is_true_positive").cast("int").alias("hit")).groupBy("period_start", "rule_id").agg(
        F.count("*").alias("a"), F.sum("hit").alias("h")
    )
    both = spine.join(daily, ["period_start", "rule_id"], "left").na.fill(0, ["a", "h"])
    before = Window.partitionBy("rule_id").orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)
    run = both.select("period_start", "rule_id", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("alerts"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("hits"))
    per = Window.partitionBy("period_start")
    pooled = F.try_divide(F.sum("hits").over(per), F.sum("alerts").over(per))
    out = run.withColumns({"observed": F.try_divide("hits", "alerts"), "pooled": F.coalesce(pooled, F.lit(0.0))})
    rate = F.try_divide(F.col("hits") + F.lit(float(weight)) * F.col("pooled"), F.col("alerts") + F.lit(float(weight)))
    return out.withColumn("hit_rate", F.coalesce(rate, F.lit(0.0)))


def b3_priority(prepared: DataFrame, weight: float) -> DataFrame:
    """prepared with priority, the best hit rate of an alert's rules in its period."""
    rates = rule_hit_rates(prepared, weight).select("period_start", "rule_id", "hit_rate")
    best = prepared.select("alert_id", "period_start", F.explode("fired_rules").alias("rule_id")).join(F.broadcast(rates), ["period_start", "rule_id"]).groupBy("alert_id").agg(F.max("hit_rate").alias("priority"))
    return prepared.join(best, "alert_id", "left").withColumn("priority", F.coalesce("priority", F.lit(0.0)))


def order_keys(rung: str, seed: int) -> list[Column]:
    """Sort keys of a rung within its period; needs priority for B3 and score for C1."""
    last = F.col("alert_id").asc()
    first = F.col("first_txn_ts").asc_nulls_last()
    return {
        "B0": [draw(F.lit(str(seed)), F.col("alert_id")).asc(), last],
        "B1": [first, last],
        "B2": [F.col("alert_amount").desc_nulls_last(), last],
        "B3": [F.col("priority").desc_nulls_last(), first, last],
        "C1": [F.col("score").desc_nulls_last(), first, last],
    }[rung]


def ranks(prepared: DataFrame, point: OperatingPoint, rungs=LADDER, task_rows: int = ordering.TASK_ROWS) -> DataFrame:
    """The whole period's positions in every rung: prepared with rank_<rung>.

    Periods of at most task_rows alerts are each ordered by one task; larger ones in ranges, with the same positions.
    """
    out = b3_priority(prepared, point.prior_weight) if "B3" in rungs else prepared
    if ordering.largest_group(prepared, "period_start") <= task_rows:
        return out.withColumns({f"rank_{r}": F.row_number().over(Window.partitionBy("period_start").orderBy(*order_keys(r, point.seed))) for r in rungs})
    needed = [c for c in ("alert_id", "period_start", "first_txn_ts", "alert_amount", "priority", "score") if c in out.columns]
    for r in rungs:
        at = ordering.positions(out.select(*needed), ["period_start"], order_keys(r, point.seed), f"rank_{r}")
        out = out.join(at.select("alert_id", "period_start", f"rank_{r}"), ["alert_id", "period_start"])
    return out


def with_scores(prepared: DataFrame, scores: DataFrame) -> DataFrame:
    """prepared joined with (alert_id, score); refuses scores that miss an alert."""
    out = prepared.join(scores.select("alert_id", "score"), "alert_id", "left")
    if not out.where("score is null").isEmpty():
        raise ValueError("some alerts have no score")
    return out


def worked_queue(prepared: DataFrame, point: OperatingPoint, rungs=LADDER) -> DataFrame:
    """The first K of every evaluation period in every rung."""
    pop = evaluated(prepared, point)
    ready = b3_priority(prepared, point.prior_weight).join(pop.select("alert_id"), "alert_id", "left_semi") if "B3" in rungs else pop
    sizes = pop.groupBy("period_start").agg(F.count("*").alias("period_alerts"))
    keep = ["period_start", "alert_id", "attempt_ids", "typologies", "is_true_positive", "unattributed_only"]
    out = None
    for r in rungs:
        w = Window.partitionBy("period_start").orderBy(*order_keys(r, point.seed))
        part = ready.withColumn("queue_position", F.row_number().over(w)).where(F.col("queue_position") <= point.k).select(F.lit(r).alias("rung"), "queue_position", *keep)
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(sizes), "period_start")  # one row a period


def unsmoothed_b3(prepared: DataFrame, point: OperatingPoint) -> DataFrame:
    import dataclasses

    return worked_queue(prepared, dataclasses.replace(point, prior_weight=0.0), ("B3",)).withColumn("rung", F.lit("B3-unsmoothed"))


# ---- metrics


def precision_per_period(worked: DataFrame) -> DataFrame:
    tp = F.sum(F.col("is_true_positive").cast("int"))
    return worked.groupBy("rung", "period_start").agg(F.count("*").alias("worked"), tp.alias("true_positives"), F.first("period_alerts").alias("population"), F.try_divide(tp, F.count("*")).alias("precision"))


def precision_pooled(worked: DataFrame) -> DataFrame:
    tp = F.sum(F.col("is_true_positive").cast("int"))
    return worked.groupBy("rung").agg(F.count("*").alias("worked"), tp.alias("true_positives"), F.try_divide(tp, F.count("*")).alias("precision"))


def attempt_universe(prepared: DataFrame, labels: DataFrame, point: OperatingPoint) -> DataFrame:
    """Attempts with a transaction in an evaluation period, and whether any of its alerts carries them."""
    live = labels.where(F.col("attempt_id").isNotNull() & (F.col("period") >= F.lit(point.evaluation_start).cast("date"))).select("attempt_id", "typology").distinct()
    seen = evaluated(prepared, point).select(F.explode("attempt_ids").alias("attempt_id")).distinct().withColumn("s", F.lit(True))
    return live.join(seen, "attempt_id", "left").select("attempt_id", "typology", F.coalesce("s", F.lit(False)).alias("surfaced"))


def period_attempt_universe(prepared: DataFrame, labels: DataFrame, day: str) -> DataFrame:
    live = labels.where(F.col("attempt_id").isNotNull() & (F.col("period") == F.lit(day).cast("date"))).select("attempt_id", "typology").distinct()
    seen = prepared.where(F.to_date("period_start") == F.lit(day).cast("date")).select(F.explode("attempt_ids").alias("attempt_id")).distinct().withColumn("s", F.lit(True))
    return live.join(seen, "attempt_id", "left").select("attempt_id", "typology", F.coalesce("s", F.lit(False)).alias("surfaced"))


def typology_recall(universe: DataFrame, worked: DataFrame) -> DataFrame:
    """Per rung and typology: attempts, surfaced, recovered by the worked queue, and the two recalls."""
    rungs = worked.select("rung").distinct()
    got = worked.select("rung", F.explode("attempt_ids").alias("attempt_id")).distinct().withColumn("r", F.lit(1))
    base = universe.crossJoin(F.broadcast(rungs)).join(got, ["rung", "attempt_id"], "left")  # a handful of rungs
    s, r = F.sum(F.col("surfaced").cast("int")), F.coalesce(F.sum("r"), F.lit(0))
    return base.groupBy("rung", "typology").agg(
        F.count("*").alias("attempts"), s.alias("surfaced"), r.alias("recovered"), F.try_divide(r, F.count("*")).alias("recall"), F.try_divide(r, F.greatest(s, F.lit(1))).alias("recall_of_surfaced")
    )


def unattributed(prepared: DataFrame, worked: DataFrame, point: OperatingPoint) -> DataFrame:
    one = F.coalesce(F.sum(F.col("unattributed_only").cast("int")), F.lit(0))
    whole = evaluated(prepared, point).agg(one.alias("population"))
    return worked.groupBy("rung").agg(one.alias("reached")).crossJoin(F.broadcast(whole))


def rule_support(universe: DataFrame) -> DataFrame:
    """Rules with the typologies that support them and those typologies' live attempts (they overlap)."""
    spark = universe.sparkSession
    bridge = spark.createDataFrame([(r, t) for r in RULES for t in (RULE_SUPPORT[r] or (None,))], "rule_id string, typology string")
    counts = universe.groupBy("typology").agg(F.count("*").alias("n"))
    return F.broadcast(bridge).join(counts, "typology", "left").groupBy("rule_id").agg(
        (F.count("typology") > 0).alias("supported"), F.array_join(F.array_sort(F.collect_set("typology")), ",").alias("typologies"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts")
    )


def lift(pooled: DataFrame) -> DataFrame:
    """Precision ratio of every rung to every other; infinite over zero."""
    a, b = pooled.select("rung", "precision"), pooled.select(F.col("rung").alias("over"), F.col("precision").alias("base"))
    ratio = F.when(F.col("base") == 0, F.lit(float("inf"))).otherwise(F.try_divide("precision", "base"))
    return a.crossJoin(F.broadcast(b)).where("rung <> over").select("rung", "over", ratio.alias("lift"))  # a handful of rungs


def reference_rung(pooled: DataFrame) -> DataFrame:
    """The ladder's rung of the highest precision; ties go to the earliest."""
    best = pooled.where(F.col("rung").isin(*LADDER)).orderBy(F.col("precision").desc(), F.col("rung")).limit(1)
    return best.select("rung", "precision")


def depth(ranked: DataFrame, rank: str, targets: DataFrame) -> DataFrame:
    """(period_start, attempts_depth, alerts_depth): how deep a ranking goes to reach a period's targets.

    targets has attempts and true_positives.  A zero target is met at depth 0; one out of reach gives null.
    """
    rows = ranked.select("period_start", F.col(rank).alias("pos"), "attempt_ids", F.col("is_true_positive").cast("int").alias("tp"))
    firsts = rows.select("period_start", "pos", F.explode("attempt_ids").alias("x")).groupBy("period_start", "x").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("period_start").orderBy("pos")
    kth = firsts.select("period_start", F.col("pos").alias("a_pos"), F.row_number().over(Window.partitionBy("period_start").orderBy("pos", "x")).alias("attempts"))
    tps = rows.where("tp = 1").select("period_start", F.col("pos").alias("t_pos"), F.row_number().over(w).alias("true_positives"))
    t = targets.select("period_start", F.col("attempts").cast("int").alias("attempts"), F.col("true_positives").cast("int").alias("true_positives"))
    t = t.join(kth, ["period_start", "attempts"], "left").join(tps, ["period_start", "true_positives"], "left")
    return t.select(
        "period_start", F.when(F.col("attempts") == 0, 0).otherwise(F.col("a_pos")).alias("attempts_depth"), F.when(F.col("true_positives") == 0, 0).otherwise(F.col("t_pos")).alias("alerts_depth")
    )


def volume_reduction(ranked: DataFrame, worked: DataFrame, rung: str, reference: str, point: OperatingPoint) -> DataFrame:
    """Per period: the depths at which rung holds what the reference's worked queue found, and the alerts freed by each.

    A freed figure may be negative; it is null where the depth is.
    """
    ref = worked.where(F.col("rung") == reference)
    targets = ref.groupBy("period_start").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("attempt_ids")))).alias("attempts"), F.sum(F.col("is_true_positive").cast("int")).alias("true_positives")
    )
    deep = depth(evaluated(ranked, point), f"rank_{rung}", targets)
    freed = {f"{x}_freed": F.lit(point.k) - F.col(f"{x}_depth") for x in ("attempts", "alerts")}
    return targets.join(deep, "period_start").withColumns(freed | {"target_was_zero": F.col("attempts") == 0})


def pooled_reduction(volume: DataFrame, point: OperatingPoint) -> DataFrame:
    """The alerts freed at equal true positives, as a share of the worked volume of the periods that have a depth."""
    return volume.agg(F.try_divide(F.sum("alerts_freed"), F.lit(point.k) * F.count("alerts_depth")).alias("reduction"))


def _correlation(a: str, b: str) -> Column:
    """Correlation of two columns, rounding kept within 1; null where one is constant, which F.corr would divide by."""
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def spearman(df: DataFrame, a: str, b: str, by: str | None = None, task_rows: int = ordering.TASK_ROWS) -> DataFrame:
    """Rank correlation with average ranks for ties, within groups if asked; null where all ranks of a side are equal.

    Groups of at most task_rows rows are each ranked by one task; larger ones in ranges, with the same ranks.
    """
    part = [by] if by else []
    if ordering.largest_group(df, *part) > task_rows:
        rows = df.select(*part, F.col(a).alias("_a"), F.col(b).alias("_b"))
        for value, rank in (("_a", "ra"), ("_b", "rb")):
            rows = rows.join(ordering.average_ranks(rows, part, value, rank), [*part, value])
        return rows.groupBy(*part).agg(_correlation("ra", "rb").alias("rho"))
    avg = lambda c: F.rank().over(Window.partitionBy(*part).orderBy(c)) + (F.count("*").over(Window.partitionBy(*part, c)) - 1) / 2
    both = df.select(*part, avg(a).alias("ra"), avg(b).alias("rb"))
    return both.groupBy(*part).agg(_correlation("ra", "rb").alias("rho"))


def scored_queue(prepared: DataFrame, scores: DataFrame, point: OperatingPoint, name: str = "C1") -> DataFrame:
    """The first K of every evaluation period by score, as one more rung; refuses scores that miss an alert of them."""
    return worked_queue(with_scores(evaluated(prepared, point), scores), point, ("C1",)).withColumn("rung", F.lit(name))


def scored_ranks(prepared: DataFrame, scores: DataFrame, point: OperatingPoint) -> DataFrame:
    """The evaluation periods' whole positions in every rung of the ladder and by score."""
    ladder = evaluated(ranks(prepared, point), point)
    return ranks(with_scores(ladder, scores), point, ("C1",))


def recall_outcomes(universe: DataFrame, worked: DataFrame, rung: str) -> DataFrame:
    """Each live attempt and whether a rung's worked queue recovers it: what recall intervals resample."""
    got = worked.where(F.col("rung") == rung).select(F.explode("attempt_ids").alias("attempt_id")).distinct().withColumn("r", F.lit(True))
    return universe.join(got, "attempt_id", "left").select("typology", "attempt_id", F.coalesce("r", F.lit(False)).alias("recovered"))


def gate(lift_point: float, interval_low: float, point: OperatingPoint) -> dict:
    """Both parts of the ship gate: the point estimate, and an interval wholly above 1."""
    return {"point_passed": lift_point >= point.gate, "interval_passed": interval_low > 1.0, "passed": lift_point >= point.gate and interval_low > 1.0}


def contribution_split(pooled: DataFrame, base: str = "B3", top: str = "C1") -> DataFrame:
    """What the base ordering already gives of the top one's true positives."""
    tp = lambda r: F.sum(F.when(F.col("rung") == r, F.col("true_positives")))
    pr = lambda r: F.sum(F.when(F.col("rung") == r, F.col("precision")))
    return pooled.agg(tp(base).alias("base_tp"), tp(top).alias("top_tp"), (tp(top) - tp(base)).alias("gain"), F.try_divide(tp(base), tp(top)).alias("share"), ((pr(top) - pr(base)) * 100).alias("points"))


def typology_table(prepared: DataFrame, labels: DataFrame, day: str, point: OperatingPoint) -> DataFrame:
    """Every typology with its attempts in the period and over the evaluation, zeros kept."""
    spine = prepared.sparkSession.createDataFrame([(t,) for t in TYPOLOGIES], "typology string")
    one = lambda u, n: u.groupBy("typology").agg(F.count("*").alias(f"{n}_attempts"), F.sum(F.col("surfaced").cast("int")).alias(f"{n}_surfaced"))
    out = spine.join(one(period_attempt_universe(prepared, labels, day), "period"), "typology", "left").join(one(attempt_universe(prepared, labels, point), "evaluation"), "typology", "left")
    return out.na.fill(0)
