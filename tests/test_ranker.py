"""The learned order against explicit pairs and numpy, walk-forward, the scored queue, the run record and the artifact."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake import queries as Q
from triagelake.operators import backtest as B
from triagelake.operators import ranker as K
from triagelake.params import FIXTURE_POINT as O
from triagelake.plans import artifact, contract, provenance, readside, record
from triagelake.sources.ledger import CSV_HEADER

SMALL = "/root/testdata/sf0.001"


def test_learned_rows_are_those_of_numpy(spark):
    """C1's precision, freed volume and importances from the collected scores and outcomes alone."""
    fitted = Q._models(spark, SMALL)
    scores = {r.alert_id: r.score for r in Q._learned_scores(spark, SMALL).collect()}
    x = {r.alert_id: [float(r[n]) for n in fitted["2024-01-30"].names] for r in Q._features(spark, SMALL).collect()}
    days = {}
    for r in Q._prepared(spark, SMALL).collect():
        day = str(r.period_start.date())
        want = fitted[day].values(np.array([x[r.alert_id]]))[0] if day in fitted else 0.0
        assert scores[r.alert_id] == pytest.approx(want)
        if day >= O.evaluation_start:
            days.setdefault(day, []).append((-scores[r.alert_id], r.first_txn_ts, r.alert_id, r.is_true_positive, r.attempt_ids))
    worked = [r for rows in days.values() for r in sorted(rows)[: O.k]]
    got = Q.queries()["learned_precision"](spark, SMALL).collect()
    assert [(r.rung, r.worked, r.true_positives) for r in got] == [("C1", len(worked), sum(r[3] for r in worked))]
    best = Q.queries()["reference_rung"](spark, SMALL).first().rung
    found = {str(r.period_start.date()): r for r in Q.queries()["learned_volume_reduction"](spark, SMALL).collect()}
    target = {}
    for r in Q._worked(spark, SMALL).where(F.col("rung") == best).collect():
        t = target.setdefault(str(r.period_start.date()), [set(), 0])
        t[0] |= set(r.attempt_ids)
        t[1] += r.is_true_positive
    assert set(found) == set(target) == set(days)
    for day, (attempts, hits) in target.items():
        seen, tp, depth = set(), 0, {"attempts": None if attempts else 0, "alerts": None if hits else 0}
        for k, r in enumerate(sorted(days[day]), 1):
            seen, tp = seen | set(r[4]), tp + r[3]
            if depth["attempts"] is None and len(seen) >= len(attempts):
                depth["attempts"] = k
            if depth["alerts"] is None and tp >= hits:
                depth["alerts"] = k
        r = found[day]
        assert (r.attempts_depth, r.alerts_depth) == (depth["attempts"], depth["alerts"])
        assert (r.attempts_freed, r.alerts_freed) == tuple(None if d is None else O.k - d for d in depth.values())
    last = fitted[max(fitted)]
    gains = dict.fromkeys(last.names, 0.0)
    for t in last.trees:
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                gains[last.names[f]] += g
    want = sorted(gains.items(), key=lambda z: (-z[1], z[0]))[:15]
    assert [(r.feature, r.importance) for r in Q.queries()["ranker_importance"](spark, SMALL).collect()] == [(n, pytest.approx(g)) for n, g in want]


def tables(spark, days=5, per_day=12, seed=2):
    r = np.random.default_rng(seed)
    rows, truth = [], []
    for day in range(days):
        for k in range(per_day):
            label = bool(r.random() < 0.4)
            start = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
            rows.append((f"{day:010d}{k:010d}", "s", start, start + dt.timedelta(days=1), float(r.normal() + 1.5 * label), float(r.normal() * 40), 7.0, "features-1"))
            truth.append((rows[-1][0], label))
    shape = "alert_id string, subject_account string, period_start timestamp_ntz, feature_cutoff_ts timestamp_ntz, signal double, noise double, same double, feature_version string"
    return spark.createDataFrame(rows, shape), spark.createDataFrame(truth, "alert_id string, is_true_positive boolean"), rows, dict(truth)


def test_pairwise_fit_is_that_of_all_pairs_formed(spark):
    features, prepared, rows, truth = tables(spark)
    got = K.pairwise_models(features, prepared, "2024-01-02", reg=0.1)
    assert list(got) == [f"2024-01-0{d}" for d in range(2, 6)]
    for day, model in got.items():
        past = [r for r in rows if str(r[2].date()) < day]
        x = np.array([r[4:7] for r in past])
        sd = x.std(axis=0)
        sd[sd == 0] = 1
        diffs = np.array([(np.array(p[4:7]) - np.array(n[4:7])) / sd for p in past for n in past if p[2] == n[2] and truth[p[0]] and not truth[n[0]]])
        want = np.linalg.solve(diffs.T @ diffs / len(diffs) + 0.1 * np.eye(3), diffs.mean(axis=0))
        assert model.pairs == len(diffs) and np.allclose(model.weights, want, atol=1e-8)
        lost = lambda w: ((1 - diffs @ w) ** 2).mean() + 0.1 * (w @ w)
        assert sum(g for _, g in model.importance()) == pytest.approx(lost(np.zeros(3)) - lost(want))
    assert got["2024-01-05"].importance()[0][0] == "signal"


def test_ridge_fit_is_numpys(spark):
    features, prepared, rows, truth = tables(spark)
    model = K.ridge_models(features, prepared, "2024-01-05", reg=0.1)["2024-01-05"]
    x = np.array([r[4:7] for r in rows if r[2].day < 5])
    y = np.array([truth[r[0]] for r in rows if r[2].day < 5], float)
    sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z = (x - x.mean(axis=0)) / sd
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z / len(z) + 0.1 * np.eye(3), z.T @ (y - y.mean()) / len(z)), atol=1e-8)


def test_scores_contributions_and_stability(spark):
    features, prepared, rows, _ = tables(spark)
    models = K.pairwise_models(features, prepared, "2024-01-02")
    scores = {r.alert_id: r.score for r in K.walk_forward(features, models).collect()}
    assert len(scores) == 48
    day = models["2024-01-05"]
    parts = {}
    for r in day.contributions(features.where(F.dayofmonth("period_start") == 5), top=3).collect():
        parts.setdefault(r.alert_id, []).append(r)
    for alert, found in parts.items():
        assert sum(r.contribution for r in found) == pytest.approx(scores[alert])
        assert [abs(r.contribution) for r in found] == sorted((abs(r.contribution) for r in found), reverse=True)
    # models of the 2nd and 3rd had one and two training periods; the pair of the 4th and 5th remains
    stable = K.rank_stability(features, models).collect()
    assert [r.period_start.day for r in stable] == [5] and -1 <= stable[0].rho <= 1


def test_outcomes_are_refused_and_days_without_pairs_have_no_model(spark):
    features, prepared, _, _ = tables(spark)
    with pytest.raises(ValueError, match="outcome"):
        K.pairwise_models(features.withColumn("is_true_positive", F.lit(True)), prepared, "2024-01-02")
    assert K.pairwise_models(features, prepared.withColumn("is_true_positive", F.lit(False)), "2024-01-02") == {}
    assert K.walk_forward(features, {}).count() == 0
    frame = K.training_frame(features, prepared, "2024-01-03")
    assert frame.count() == 24 and "label" in frame.columns
    groups = {r.period_start.day: (r.alerts, r.positives, r.pairs) for r in K.ranking_groups(features, prepared, "2024-01-03").collect()}
    assert set(groups) == {1, 2} and all(c == b * (a - b) for a, b, c in groups.values())


@pytest.mark.parametrize("make", [lambda: K.LogisticRanker(iterations=10), lambda: K.TreeRanker(rounds=3, depth=2)])
def test_other_rankers_keep_the_protocol(spark, make):
    features, prepared, rows, truth = tables(spark, days=3)
    models = K.models(features, prepared, "2024-01-03", make)
    scored = {r.alert_id: r.score for r in K.walk_forward(features, models).collect()}
    assert len(scored) == 12 and models["2024-01-03"].importance()[0][0] == "signal"


def test_scores_that_miss_an_alert_are_refused(spark):
    prepared = Q._prepared(spark, SMALL)
    with pytest.raises(ValueError, match="no score"):
        B.with_scores(prepared, Q._plain_scores(spark, SMALL).limit(3))


@pytest.mark.parametrize("lift, low, passed", [(1.31, 1.01, True), (1.3, 1.0, False), (1.29, 1.2, False), (2.0, 0.9, False)])
def test_gate_needs_the_point_and_the_interval(lift, low, passed):
    assert B.gate(lift, low, O)["passed"] is passed


@pytest.fixture(scope="module")
def built(spark):
    return Q._artifact(spark, SMALL), Q._record(spark, SMALL)


def test_artifact_blocks_agree_with_the_queries(spark, built):
    made, run = built
    queue = {r.alert_id: r for r in B.scored_ranks(Q._prepared(spark, SMALL), Q._learned_scores(spark, SMALL), O).where("to_date(period_start) = '2024-01-10'").collect()}
    assert {r["alert_id"] for r in made["queue"]} == set(queue) and made["period"]["alerts"] == len(queue)
    for r in made["queue"]:
        assert r["ranks"] == {n: queue[r["alert_id"]][f"rank_{n}"] for n in record.RUNGS}
        assert r["subject"].startswith("Party-") and len(r["transactions"]) == min(r["transaction_count"], artifact.MAX_TXNS) and len(r["contributions"]) == 5
    best = Q.queries()["reference_rung"](spark, SMALL).first()
    assert made["result"]["gate"]["reference_rung"] == best.rung and made["result"]["gate"]["promoted"] is False
    gate = Q.queries()["learned_gate"](spark, SMALL).first()
    assert made["result"]["gate"]["lift"] == pytest.approx(gate.lift) and made["result"]["gate"]["met"] == gate.point_passed
    assert [m["ordering"] for m in made["result"]["measured"]] == list(record.RUNGS)
    parts = made["evidence"]
    funnel = Q.queries()["funnel"](spark, SMALL).collect()
    assert parts["funnel"]["attempts_live"] == funnel[0].live and parts["funnel"]["attempts_surfaced"] == funnel[0].surfaced
    assert {r.rung: r.recovered for r in funnel}.items() <= parts["funnel"]["attempts_reached"].items()
    assert len(parts["per_period"]) == made["result"]["evaluation_periods"] == len(parts["volume_reduction"]["per_period"])
    assert len(parts["feature_importance"]["top"]) == 15 and parts["feature_importance"]["features_in_model"] == 39
    assert [r["rule_id"] for r in made["rules"]] == [f"R{n}" for n in range(1, 9)] and len(made["typologies"]) == 8
    assert json.loads(artifact.canonical(run))["k"] == O.k
    text = json.dumps(made["queue"])
    assert "|" not in text and "threshold" not in text  # no raw account, no parameter


def test_admission_and_projections(built, tmp_path):
    made, _ = built
    ok = {"public_distribution_status": "approved"}
    wide = contract.limits(periods=31)  # the bundled tables have more periods than a published run
    assert artifact.admit(made, made["artifact_sha256"], ok, limits=wide) is made
    artifact.write_json(str(tmp_path / "a.json"), made)
    assert artifact.load_json(str(tmp_path / "a.json")) == made and (tmp_path / "a.json").read_bytes().endswith(b"}\n")
    for bad, pin, why, match in (
        ({**made, "artifact_schema": "x"}, None, ok, "schema"), ({**made, "queue": []}, None, ok, "digest"), (made, "0" * 64, ok, "pinned"), (made, None, {}, "approved"),
        (made, None, ok, "evidence.per_period: 27"),
    ):
        with pytest.raises(ValueError, match=match):
            artifact.admit(bad, pin, why)
    assert set(readside.period_view(made)) >= {"period", "result", "period_attempts"} and readside.evidence_view(made)["k"] == O.k
    assert readside.provenance(made)["slice_sha256"] == made["artifact_sha256"] and readside.methodology(made)["gate"]["promoted"] is False
    assert artifact.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}\n'.encode()


def test_the_queue_query_has_all_rows_whatever_an_artifact_may_hold(spark, built, monkeypatch):
    want = sorted((r["alert_id"], r["subject"], r["transaction_count"], len(r["transactions"]), len(r["contributions"]), r["rank_B3"], r["rank_C1"]) for r in artifact.rows_of(built[0]))
    monkeypatch.setattr(artifact, "MAX_ALERTS", 0)
    assert want and sorted(tuple(r) for r in Q.queries()["artifact_queue"](spark, SMALL).collect()) == want


def test_another_period_without_alerts_is_refused(spark, built):
    with pytest.raises(ValueError, match="no alert"):
        artifact.build_artifact(Q._alerts(spark, SMALL), Q._txns(spark, SMALL), Q._prepared(spark, SMALL), Q._labels(spark, SMALL), "2030-01-01", O, {}, Q._learned_scores(spark, SMALL), Q._contributions(spark, SMALL), built[1])


def test_source_manifest_and_distribution(spark, tmp_path):
    path = tmp_path / "trans.csv"
    path.write_text(CSV_HEADER + "\n2022/09/01 00:10,1,A,2,B,1.00,Euro,1.00,Euro,ACH,0\n")
    about = {"provider": "p", "dataset": "d", "dataset_version": 8, "license": "L", "license_url": "u"}
    made = provenance.record_source_manifest(spark, str(path), "2024-01-01T00:00:00Z", "ref", about)
    digest = provenance.validate_source(spark, str(path), made, about)
    assert digest == artifact.sha256_file(str(path)) and len(made["source_schema"]) == 11
    for change in ({"verification_status": "open"}, {"source_file": "other.csv"}, {"dataset_version": 7}, {"source_sha256": "0"}):
        with pytest.raises(ValueError):
            provenance.validate_source(spark, str(path), made | change, about)
    good = {"public_distribution_status": "approved", "dataset_version": 8, "license": "L", "approved_source_sha256": digest}
    provenance.validate_distribution(good, digest, about)
    for change in ({"public_distribution_status": "no"}, {"license": "M"}, {"approved_source_sha256": "0"}):
        with pytest.raises(ValueError):
            provenance.validate_distribution(good | change, digest, about)
    with pytest.raises(ValueError):
        provenance.record_source_manifest(spark, str(path), "some day", "ref", about)


def test_replay_holds_no_table_of_flagged_payments_in_a_task(spark, monkeypatch):
    written, txns = [], Q._txns(spark, SMALL)
    monkeypatch.setattr(artifact, "settled", lambda df: written.append(df) or df)
    artifact.replay_cases(txns, txns.where("txn_id % 3 = 0").select("txn_id"))
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
