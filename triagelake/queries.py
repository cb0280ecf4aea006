"""Registered queries: every operator on the bundled tables, with scalar columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import backtest as B
from triagelake.operators import daily, lambdamart, resample, rules, store
from triagelake.operators import features as FE
from triagelake.operators import ranker as K
from triagelake.params import FIXTURE_BOOST
from triagelake.params import FIXTURE_PARAMS as P
from triagelake.params import FIXTURE_POINT as O
from triagelake.plans import artifact, readside, record
from triagelake.session import discard, scratch, settled
from triagelake.sources import ledger
from triagelake.streaming import daily_counts

_SHARED: dict[tuple, object] = {}


def release(spark: SparkSession | None = None) -> None:
    """Forgets the shared tables, for instance between timed queries; with a session, deletes every written table too."""
    _SHARED.clear()
    if spark is not None:
        discard(spark)


def _once(name: str, spark: SparkSession, d: str, make) -> DataFrame:
    """A frame that many queries start from, written once to the scratch folder and shared until release()."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _SHARED:
        _SHARED[key] = settled(make())
    return _SHARED[key]


def _txns(s: SparkSession, d: str) -> DataFrame:
    return _once("ledger", s, d, lambda: ledger.events_ledger(s, d))


def _daily(s, d):
    return _once("daily", s, d, lambda: daily.activity(_txns(s, d)))


def _rows(s, d):
    return _once("rows", s, d, lambda: rules.run_rules(_txns(s, d), ledger.events_jurisdictions(s, d), P, _daily(s, d)))


def _alerts(s, d):
    return _once("alerts", s, d, lambda: store.build_alerts(_rows(s, d), P))


def _labels(s, d):
    return ledger.events_labels(s, d)


def _prepared(s, d):
    return _once("prepared", s, d, lambda: B.prepare(_alerts(s, d), _txns(s, d), _labels(s, d)))


def _ranked(s, d):
    return _once("ranked", s, d, lambda: B.ranks(_prepared(s, d), O))


def _worked(s, d):
    return _once("worked", s, d, lambda: B.worked_queue(_prepared(s, d), O))


def _features(s, d):
    return _once("features", s, d, lambda: FE.build_features(_alerts(s, d), _txns(s, d), P, _daily(s, d)))


def _universe(s, d):
    return B.attempt_universe(_prepared(s, d), _labels(s, d), O)


def _pooled(s, d):
    return B.precision_pooled(_worked(s, d))


def _volume(s, d):
    return B.volume_reduction(_ranked(s, d), _worked(s, d), "B3", "B2", O)


def _plain_days(df: DataFrame) -> DataFrame:
    return df.withColumn("s", F.col("s").cast("double"))


def _extended(s, d):
    """The daily activity as it grows: built of the first ten days, extended by five, and by all from the twelfth on."""
    txns, path = _txns(s, d), f"{scratch(s)}/daily-{uuid.uuid4().hex}"
    day = lambda n: F.lit(f"2024-01-{n:02d}").cast("date")
    daily.build(txns.where(F.col("period") <= day(10)), path)
    daily.extend(s, txns.where(F.col("period").between(day(11), day(15))), path)
    daily.extend(s, txns.where(F.col("period") >= day(12)), path)
    return _plain_days(daily.read(s, path))


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-separated text."""
    return df.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in columns})


def _rule(name: str):
    def run(s, d):
        return _text(rules.each_rule(_txns(s, d), ledger.events_jurisdictions(s, d), P)[name][0], "txn_ids")

    return run


def _rule_rows(s, d):
    n = F.coalesce(*[F.get_json_object("evidence", f"$.{k}") for k in ("count", "pairs", "counterparties")]).cast("long")
    return _text(_rows(s, d).select("subject_account", "period", "rule_id", n.alias("n"), F.col("contributing_txn_ids").alias("txn_ids")), "txn_ids")


def _order(rung: str):
    return lambda s, d: _ranked(s, d).select("period_start", "alert_id", F.col(f"rank_{rung}").alias("position"))


def _leakage(s, d):
    bad = FE.leakage_report(_alerts(s, d), _txns(s, d), P, 200)
    sampled = FE.leakage_sample(_alerts(s, d), 200).agg(F.count("*").cast("int").alias("sampled"))
    return sampled.crossJoin(F.broadcast(bad.agg(F.count("*").cast("int").alias("leaking_features"))))


def _reads_ahead(alerts, txns, p):
    """A builder that breaks the rule on purpose: it counts an account's payments of all days."""
    ever = txns.groupBy(F.col("from_account").alias("subject_account")).agg(F.count("*").alias("ever_out_count"))
    built = FE.build_features(alerts, txns, p)
    return built.join(ever, "subject_account", "left").na.fill(0, ["ever_out_count"]).select(*built.columns, "ever_out_count")


def _leakage_caught(s, d):
    return FE.leakage_report(_alerts(s, d), _txns(s, d), P, 200, build=_reads_ahead)


def _models(s, d) -> dict[str, lambdamart.LambdaMart]:
    """C1's models, trained once and shared until release()."""
    key = (s.sparkContext.applicationId, "models", d)
    if key not in _SHARED:
        _SHARED[key] = lambdamart.lambdamart_models(_features(s, d), _prepared(s, d), O.evaluation_start, FIXTURE_BOOST)
    return _SHARED[key]


def _linear_models(s, d):
    return K.pairwise_models(_features(s, d), _prepared(s, d), O.evaluation_start)


def _importance(s, d):
    fitted = _models(s, d)
    last = list(fitted.values())[-1:]
    rows = [(n, float(v)) for m in last for n, v in m.importance()[:15]]
    return s.createDataFrame(rows, "feature string, importance double")


def _contributions(s, d, day=None):
    fitted = _models(s, d)
    if not fitted or day is not None and day not in fitted:
        return s.createDataFrame([], "alert_id string, feature string, value double, contribution double")
    day = day or max(fitted)
    return fitted[day].contributions(_features(s, d).where(F.to_date("period_start") == F.lit(day).cast("date")))


def _plain_scores(s, d):
    """Scores that any engine can give: an order by fired rules and the period's payments."""
    return _features(s, d).select("alert_id", (100.0 * F.col("fired_rule_count") + F.col("period_out_count") + F.col("period_in_count")).alias("score"))


def _learned_scores(s, d):
    """The boosted model's scores; alerts of days without a model are equal."""
    scored = K.walk_forward(_features(s, d), _models(s, d)).select("alert_id", "score")
    return _features(s, d).select("alert_id").join(scored, "alert_id", "left").na.fill(0.0, ["score"])


def _five(s, d, scores=_plain_scores):
    """The worked queues of the ladder and of the scored order."""
    name = f"five {scores.__name__}"
    return _once(name, s, d, lambda: _worked(s, d).unionByName(B.scored_queue(_prepared(s, d), scores(s, d), O)))


def _scored_volume(s, d, scores=_plain_scores):
    best = B.reference_rung(_pooled(s, d)).first()
    return B.volume_reduction(B.scored_ranks(_prepared(s, d), scores(s, d), O), _worked(s, d), "C1", best.rung if best else "B0", O)


def _gate(s, d, scores=_plain_scores):
    """The lift of the scored order over the strongest rung, its interval, and both tests of the gate."""
    five = _five(s, d, scores)
    best = B.reference_rung(_pooled(s, d)).first()
    over = best.rung if best else "B0"
    got = B.lift(B.precision_pooled(five)).where(f"rung = 'C1' and over = '{over}'").crossJoin(resample.bootstrap_lift(B.precision_per_period(five), "C1", over, 1000, O.seed))  # one row each
    first = got.select("over", "lift", "low", "high").first()
    made = [] if first is None else [(first.over, first.lift, first.low, first.high, *B.gate(first.lift, first.low or 0.0, O).values())]
    return s.createDataFrame(made, "reference_rung string, lift double, low double, high double, point_passed boolean, interval_passed boolean, passed boolean")


def _dispositions(s, d):
    """Decisions on worked alerts, several for some, told apart by when they were taken."""
    bad = F.col("rung").isin("B1", "B3") & F.col("is_true_positive")
    return _worked(s, d).select("alert_id", F.col("rung").alias("at"), F.when(bad, "escalated").otherwise("closed").alias("disposition"))


def _record(s, d) -> dict:
    fitted = _models(s, d)
    prepared, scores = _prepared(s, d), _learned_scores(s, d)
    m = record.metrics(prepared, _labels(s, d), scores, O)
    keys = _alerts(s, d).select("engine_version", "param_set_hash").first().asDict()
    last = fitted[max(fitted)].importance() if fitted else []
    return record.run_record(m, O, keys | {"store_digest": store.store_digest(_alerts(s, d))}, {"model_version": "lambdamart-1", "features": list(FE.FEATURES)}, last, K.rank_stability(_features(s, d), fitted))


def _artifact(s, d) -> dict:
    return artifact.build_artifact(_alerts(s, d), _txns(s, d), _prepared(s, d), _labels(s, d), "2024-01-10", O, {"dataset": "events"}, _learned_scores(s, d), _contributions(s, d, "2024-01-10"), _record(s, d))


def _artifact_queue(s, d):
    """The whole queue of the artifact's period as rows: what the desk reads. A published artifact holds it if the contract's bound allows."""
    queue = artifact.queue_table(_alerts(s, d), _txns(s, d), _prepared(s, d), "2024-01-10", O, _learned_scores(s, d), _contributions(s, d, "2024-01-10"))
    size = lambda c: F.size(c).cast("long")
    return queue.select(
        "alert_id", "subject", "transaction_count", size("transactions").alias("shown"), size("contributions").alias("explained"), F.col("rank_B3").alias("rank_b3"), F.col("rank_C1").alias("rank_c1")
    )


def _replay(s, d):
    rails = F.when(F.col("format") == "purchase", "Cash").when(F.col("format") == "click", "ACH").when(F.col("format") == "view", "Credit Card").otherwise("Cheque")
    flagged = _txns(s, d).where("format <> 'signup' and amount >= 20 and txn_id % 3 = 0").select("txn_id")
    return _once("replay", s, d, lambda: artifact.replay_cases(_txns(s, d).withColumn("format", rails), flagged))


def queries() -> dict:
    h = [f for f in FE.FEATURES if f.startswith("history_")]
    flags = [f for f in FE.FEATURES if f.startswith("fired_") or f in ("contributing_transactions", "period_over_history_rate", "period_counterparty_ratio", "period_over_history_amount")]
    sides = [f for f in FE.FEATURES if f.startswith(("period_out_", "period_in_"))]
    shape = ["period_hour_spread", "period_whole_dollar_share", "period_corridor_format_share", "period_cross_bank_share", "period_currencies"]
    each = {"r1_structuring": "R1", "r2_rapid_movement": "R2", "r3_fan_in": "R3", "r4_fan_out": "R4", "r5_round_amounts": "R5", "r6_dormant_active": "R6", "r7_corridor": "R7", "r8_peer_velocity": "R8"}
    return {
        "ledger_load": ledger.events_ledger,
        "daily_activity": lambda s, d: _plain_days(daily.activity(_txns(s, d))),
        "daily_extended": _extended,
        "bank_jurisdictions": ledger.events_jurisdictions,
        **{k: _rule(v) for k, v in each.items()},
        "rule_rows": _rule_rows,
        "rule_report": lambda s, d: rules.rule_report(_rows(s, d), _txns(s, d)),
        "alert_volume": lambda s, d: rules.alert_volume(_rows(s, d)),
        "mean_alerts": lambda s, d: rules.mean_alerts(_rows(s, d)),
        "rule_overlap": lambda s, d: rules.overlap(_rows(s, d)),
        "excluded_by_window": lambda s, d: rules.excluded_by_window(_txns(s, d), "2024-01-04", "2024-01-20"),
        "alerts": lambda s, d: _text(_alerts(s, d).drop("rule_evidence", "feature_cutoff_ts"), "fired_rules", "contributing_txn_ids").withColumnRenamed("contributing_txn_ids", "txn_ids"),
        "period_index": lambda s, d: store.period_index(_alerts(s, d)),
        "alert_evidence": lambda s, d: store.publishable_evidence(_alerts(s, d)),
        "described_evidence": lambda s, d: store.described_evidence(_alerts(s, d)),
        "features_history": lambda s, d: _features(s, d).select("alert_id", *h),
        "features_period": lambda s, d: _features(s, d).select("alert_id", *sides),
        "features_shape": lambda s, d: _features(s, d).select("alert_id", *shape),
        "features_flags": lambda s, d: _features(s, d).select("alert_id", *flags),
        "leakage_gate": _leakage,
        "labels": _labels,
        "prepared": lambda s, d: _text(_prepared(s, d), "fired_rules", "attempt_ids", "typologies"),
        "evaluation_periods": lambda s, d: B.evaluation_periods(_prepared(s, d), O),
        "population_base_rate": lambda s, d: B.population_base_rate(_prepared(s, d), O),
        "rule_hit_rates": lambda s, d: B.rule_hit_rates(_prepared(s, d), O.prior_weight),
        **{f"order_b{i}": _order(f"B{i}") for i in range(4)},
        "worked_queue": lambda s, d: _worked(s, d).drop("attempt_ids", "typologies"),
        "unsmoothed_b3": lambda s, d: B.unsmoothed_b3(_prepared(s, d), O).select("rung", "alert_id", "queue_position"),
        "precision_per_period": lambda s, d: B.precision_per_period(_worked(s, d)),
        "precision_pooled": _pooled,
        "attempt_universe": _universe,
        "typology_recall": lambda s, d: B.typology_recall(_universe(s, d), _worked(s, d)),
        "unattributed": lambda s, d: B.unattributed(_prepared(s, d), _worked(s, d), O),
        "rule_support": lambda s, d: B.rule_support(_universe(s, d)),
        "lift": lambda s, d: B.lift(_pooled(s, d)),
        "reference_rung": lambda s, d: B.reference_rung(_pooled(s, d)),
        "volume_reduction": _volume,
        "pooled_reduction": lambda s, d: B.pooled_reduction(_volume(s, d), O),
        "bootstrap_mean": lambda s, d: resample.bootstrap_mean(_worked(s, d), "rung", ["period_start", "queue_position"], "is_true_positive", 1000, O.seed),
        "bootstrap_poisson": lambda s, d: resample.poisson_mean(B.evaluated(_prepared(s, d), O).withColumn("day", F.date_format("period_start", "yyyy-MM-dd")), "day", ["alert_id"], "is_true_positive", 1000, O.seed),
        "bootstrap_lift": lambda s, d: resample.bootstrap_lift(B.precision_per_period(_worked(s, d)), "B3", "B0", 1000, O.seed),
        "spearman_b2_b3": lambda s, d: B.spearman(_ranked(s, d), "rank_B2", "rank_B3", "period_start").withColumn("rho", F.round("rho", 9)),
        "coverage_at_depth": lambda s, d: readside.coverage(_ranked(s, d), "rank_B3", O.k),
        "loses_coverage_first": lambda s, d: readside.loses_coverage_first(readside.coverage(_ranked(s, d), "rank_B3", O.k)),
        "queue_view": lambda s, d: readside.queue_view(_ranked(s, d), "rank_B3", typology="CYCLE").select("period_start", "alert_id", "position"),
        "best_and_worst": lambda s, d: readside.best_and_worst(_volume(s, d)),
        "bounded_transactions": lambda s, d: artifact.bounded_transactions(_alerts(s, d), _txns(s, d)),
        "rule_table": lambda s, d: artifact.rule_table(_alerts(s, d), "2024-01-10", _universe(s, d)),
        "funnel": lambda s, d: artifact.funnel(_prepared(s, d), _universe(s, d), _worked(s, d), O),
        "replay_cases": _replay,
        "topology": lambda s, d: readside.topology(_replay(s, d)),
        "case_list": lambda s, d: readside.case_list(_replay(s, d)),
        "ranker_scores": lambda s, d: K.walk_forward(_features(s, d), _models(s, d)),
        "pairwise_scores": lambda s, d: K.walk_forward(_features(s, d), _linear_models(s, d)),
        "ranker_importance": _importance,
        "ranker_contributions": _contributions,
        "rank_stability": lambda s, d: K.rank_stability(_features(s, d), _models(s, d)),
        "leakage_caught": _leakage_caught,
        "order_c1": lambda s, d: B.scored_ranks(_prepared(s, d), _plain_scores(s, d), O).select("period_start", "alert_id", F.col("rank_C1").alias("position")),
        "scored_queue": lambda s, d: B.scored_queue(_prepared(s, d), _plain_scores(s, d), O).drop("attempt_ids", "typologies"),
        "scored_precision": lambda s, d: B.precision_pooled(_five(s, d)),
        "scored_precision_per_period": lambda s, d: B.precision_per_period(_five(s, d)).where("rung = 'C1'"),
        "scored_lift": lambda s, d: B.lift(B.precision_pooled(_five(s, d))).where("rung = 'C1'"),
        "scored_typology_recall": lambda s, d: B.typology_recall(_universe(s, d), _five(s, d)).where("rung = 'C1'"),
        "scored_unattributed": lambda s, d: B.unattributed(_prepared(s, d), _five(s, d), O).where("rung = 'C1'"),
        "scored_volume_reduction": _scored_volume,
        "scored_reduction": lambda s, d: B.pooled_reduction(_scored_volume(s, d), O),
        "scored_gate": _gate,
        "recall_intervals": lambda s, d: resample.bootstrap_mean(B.recall_outcomes(_universe(s, d), _five(s, d), "C1"), "typology", ["attempt_id"], "recovered", 1000, O.seed),
        "contribution_split": lambda s, d: B.contribution_split(B.precision_pooled(_five(s, d))),
        "learned_precision": lambda s, d: B.precision_pooled(_five(s, d, _learned_scores)).where("rung = 'C1'"),
        "learned_volume_reduction": lambda s, d: _scored_volume(s, d, _learned_scores),
        "learned_gate": lambda s, d: _gate(s, d, _learned_scores),
        "ranking_groups": lambda s, d: K.ranking_groups(_features(s, d), _prepared(s, d), "2024-01-15"),
        "training_frame": lambda s, d: K.training_frame(_features(s, d), _prepared(s, d), "2024-01-15").select("alert_id", "period_start", "label", "fired_rule_count", "period_out_count"),
        "period_attempts": lambda s, d: B.period_attempt_universe(_prepared(s, d), _labels(s, d), "2024-01-10"),
        "typology_table": lambda s, d: B.typology_table(_prepared(s, d), _labels(s, d), "2024-01-10", O),
        "artifact_queue": _artifact_queue,
        "case_timeline": lambda s, d: readside.timeline(_replay(s, d), "sim-mixed", "Cash", 3),
        "case_evidence": lambda s, d: readside.case_evidence(_replay(s, d)),
        "queue": lambda s, d: readside.queue(_ranked(s, d), "B2", O.k).select("period_start", "alert_id", "position", "worked"),
        "alert_detail": lambda s, d: readside.alert_view(_ranked(s, d), _alerts(s, d).agg(F.min("alert_id")).first()[0] or "0" * 20, "B1").select("alert_id", "subject_account", "period_start", "position"),
        "capacity": lambda s, d: readside.capacity(store.period_index(_alerts(s, d)), 7.5, 12),
        "queue_view_unattributed": lambda s, d: readside.queue_view(_ranked(s, d), "rank_B1", unattributed=True).select("period_start", "alert_id", "position"),
        "queue_view_disposition": lambda s, d: readside.queue_view(_ranked(s, d), "rank_B2", dispositions=_dispositions(s, d), disposition="escalated").select("period_start", "alert_id", "position"),
        "daily_counts": lambda s, d: daily_counts(s.read.parquet(f"{d}/events.parquet")),
    }
