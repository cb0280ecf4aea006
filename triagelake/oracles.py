"""DuckDB SQL for the registered queries, composed of shared common table expressions."""

from __future__ import annotations

from triagelake.operators.store import QUANTITIES
from triagelake.params import ENGINE, FIXTURE_PARAMS, FIXTURE_POINT, RULE_SUPPORT, RULES, TYPOLOGIES

P, O = FIXTURE_PARAMS, FIXTURE_POINT

_LEDGER = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ledger AS (
  SELECT event_id AS txn_id, ts, (user_id % 25) || '|' || user_id AS from_account, (k % 25) || '|' || k AS to_account, user_id % 25 AS from_bank, k % 25 AS to_bank,
    value AS amount, CASE WHEN event_id % 4 = 0 THEN 'Euro' ELSE 'US Dollar' END AS currency, event_type AS format, CAST(ts AS DATE) AS period
  FROM raw WHERE user_id <> k),
juris AS (SELECT CAST(n_nationkey AS BIGINT) AS bank, r_name AS jurisdiction FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _fan(name: str, subject: str, other: str, window: int, least: int) -> str:
    return f"""
{name} AS (
  SELECT a.s AS subject_account, a.period, count(DISTINCT t.{other}) AS n, CAST(sum(CAST(t.amount AS DECIMAL(18,2))) AS DOUBLE) AS total, list_sort(list(DISTINCT t.txn_id)) AS ids
  FROM (SELECT DISTINCT {subject} AS s, period FROM ledger) a JOIN ledger t ON t.{subject} = a.s AND t.period BETWEEN a.period - {window - 1} AND a.period
  GROUP BY 1, 2 HAVING count(DISTINCT t.{other}) >= {least})"""


_FORMATS = ", ".join(f"'{f}'" for f in P.r7_formats)
_RULES = f"""
r1 AS (
  SELECT from_account AS subject_account, period, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, list_sort(list(txn_id)) AS ids FROM ledger
  WHERE currency = 'US Dollar' AND amount >= {P.r1_threshold * (1 - P.r1_band)}::DOUBLE AND amount < {P.r1_threshold}::DOUBLE GROUP BY 1, 2 HAVING count(*) >= {P.r1_min_count}),
r2 AS (
  SELECT i.to_account AS subject_account, i.period, count(*) AS n, max(i.amount) AS max_amount,
    list_sort(list_distinct(list_concat(list(i.txn_id), list(o.txn_id)))) AS ids
  FROM ledger i JOIN ledger o ON i.to_account = o.from_account AND i.period = o.period
  WHERE i.amount >= {P.r2_min_amount} AND o.amount >= {P.r2_min_amount} AND o.ts >= i.ts AND date_sub('hour', i.ts, o.ts) <= {P.r2_max_hours}
    AND abs(o.amount - i.amount) <= i.amount * {P.r2_tolerance}::DOUBLE GROUP BY 1, 2),{_fan("r3", "to_account", "from_account", P.r3_window_periods, P.r3_min_originators)},{_fan("r4", "from_account", "to_account", P.r4_window_periods, P.r4_min_beneficiaries)},
r5 AS (
  SELECT from_account AS subject_account, period, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, list_sort(list(txn_id)) AS ids FROM ledger
  WHERE currency = 'US Dollar' AND amount >= {P.r5_min_amount} AND CAST(round(amount * 100) AS BIGINT) % {round(P.r5_multiple * 100)} = 0 GROUP BY 1, 2 HAVING count(*) >= {P.r5_min_count}),
out_days AS (SELECT from_account AS s, from_bank AS bank, period, count(*) AS n, list_sort(list(txn_id)) AS ids FROM ledger GROUP BY 1, 2, 3),
r6 AS (
  SELECT s AS subject_account, period, n, prior, ids FROM (
    SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY s ORDER BY period RANGE BETWEEN INTERVAL {P.r6_lookback_periods} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS prior FROM out_days)
  WHERE period >= (SELECT min(period) FROM ledger) + {P.r6_lookback_periods} AND prior <= {P.r6_dormancy_ceiling} AND n >= {P.r6_activation_count}),
r7 AS (
  SELECT from_account AS subject_account, period, count(*) AS n, count(DISTINCT b.jurisdiction) AS jurisdictions, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, list_sort(list(txn_id)) AS ids
  FROM ledger JOIN juris a ON from_bank = a.bank JOIN juris b ON to_bank = b.bank
  WHERE a.jurisdiction <> b.jurisdiction AND format IN ({_FORMATS}) AND amount >= {P.r7_min_amount} GROUP BY 1, 2 HAVING count(*) >= {P.r7_min_count}),
r8 AS (
  SELECT s AS subject_account, period, n, round(own_mean, 3) AS own_mean, round(peer_mean, 3) AS peer_mean, prior_periods, ids FROM (
    SELECT *, avg(n) OVER w AS own_mean, count(n) OVER w AS prior_periods, avg(n) OVER (PARTITION BY bank, period) AS peer_mean FROM out_days
    WINDOW w AS (PARTITION BY s, bank ORDER BY period RANGE BETWEEN INTERVAL {P.r8_lookback_periods} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
  WHERE prior_periods >= {P.r8_min_prior_periods} AND n >= {P.r8_min_count} AND n >= {P.r8_own_multiple} * own_mean AND n >= {P.r8_peer_multiple} * peer_mean)"""

_ROWS = "\nrule_rows AS (" + " UNION ALL ".join(f"SELECT subject_account, period, '{r}' AS rule_id, n, ids FROM {r.lower()}" for r in RULES) + ")"
_HASH = "lpad(CAST(CAST('0x' || substr(sha256({}), 1, 15) AS BIGINT) AS VARCHAR), 20, '0')"
_ALERTS = f"""
alerts AS (
  SELECT {_HASH.format("subject_account || '|' || strftime(period, '%Y-%m-%d') || '|' || rules")} AS alert_id, * FROM (
    SELECT subject_account, period, string_agg(rule_id, ',' ORDER BY rule_id) AS rules, list_sort(list(rule_id)) AS fired, list_sort(list_distinct(flatten(list(ids)))) AS ids
    FROM rule_rows GROUP BY 1, 2))"""
_NAMES = "[" + ", ".join(f"'{t}'" for t in TYPOLOGIES) + "]"
_LABELS = f"""
labels_ AS (
  SELECT event_id AS txn_id, CAST(ts AS DATE) AS period, CASE WHEN k % 3 <> 0 THEN k END AS attempt_id, CASE WHEN k % 3 <> 0 THEN ({_NAMES})[CAST(k % 8 + 1 AS BIGINT)] END AS typology
  FROM raw WHERE event_type = 'error' AND value >= 100)"""
_PREPARED = """
alert_txns AS (SELECT alert_id, unnest(ids) AS txn_id FROM alerts),
facts AS (SELECT alert_id, min(ts) AS first_txn_ts, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS alert_amount FROM alert_txns JOIN ledger USING (txn_id) GROUP BY 1),
hits AS (
  SELECT alert_id, count(*) AS laundering_transactions, coalesce(list_sort(list(DISTINCT attempt_id) FILTER (attempt_id IS NOT NULL)), []) AS attempts,
    coalesce(list_sort(list(DISTINCT typology) FILTER (typology IS NOT NULL)), []) AS types FROM alert_txns JOIN labels_ USING (txn_id) GROUP BY 1),
prepared AS (
  SELECT a.alert_id, a.subject_account, a.period, a.fired, f.first_txn_ts, f.alert_amount, coalesce(h.laundering_transactions, 0) AS laundering_transactions,
    coalesce(h.attempts, []) AS attempts, coalesce(h.types, []) AS types, h.alert_id IS NOT NULL AS tp, h.alert_id IS NOT NULL AND len(h.attempts) = 0 AS unattr
  FROM alerts a JOIN facts f USING (alert_id) LEFT JOIN hits h USING (alert_id))"""
_CATALOGUE = "(VALUES " + ", ".join(f"('{r}')" for r in RULES) + ") c(rule_id)"
_RATES = f"""
daily_rates AS (SELECT period, unnest(fired) AS rule_id, CAST(tp AS INT) AS h FROM prepared),
spine AS (SELECT p.period, c.rule_id FROM (SELECT DISTINCT period FROM prepared) p CROSS JOIN {_CATALOGUE}),
counted AS (SELECT s.period, s.rule_id, count(d.h) AS a, coalesce(sum(d.h), 0) AS h FROM spine s LEFT JOIN daily_rates d USING (period, rule_id) GROUP BY 1, 2),
running AS (
  SELECT period, rule_id, CAST(coalesce(sum(a) OVER w, 0) AS BIGINT) AS alerts, CAST(coalesce(sum(h) OVER w, 0) AS BIGINT) AS hits FROM counted
  WINDOW w AS (PARTITION BY rule_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (
  SELECT *, CAST(hits AS DOUBLE) / nullif(alerts, 0) AS observed,
    coalesce(CAST(sum(hits) OVER (PARTITION BY period) AS DOUBLE) / nullif(CAST(sum(alerts) OVER (PARTITION BY period) AS DOUBLE), 0), 0) AS pooled FROM running),
smooth AS (SELECT *, (hits + {O.prior_weight}::DOUBLE * pooled) / (alerts + {O.prior_weight}::DOUBLE) AS hit_rate FROM rates),
prio AS (
  SELECT p.alert_id, max(s.hit_rate) AS priority FROM (SELECT alert_id, period, unnest(fired) AS rule_id FROM prepared) p JOIN smooth s USING (period, rule_id) GROUP BY 1)"""
_RANKED = f"""
ranked AS (
  SELECT p.*, priority,
    row_number() OVER (PARTITION BY period ORDER BY CAST('0x' || substr(md5('{O.seed}|' || alert_id), 1, 15) AS BIGINT), alert_id) AS rank_b0,
    row_number() OVER (PARTITION BY period ORDER BY first_txn_ts, alert_id) AS rank_b1,
    row_number() OVER (PARTITION BY period ORDER BY alert_amount DESC, alert_id) AS rank_b2,
    row_number() OVER (PARTITION BY period ORDER BY priority DESC, first_txn_ts, alert_id) AS rank_b3
  FROM prepared p JOIN prio USING (alert_id)),
eval AS (SELECT * FROM ranked WHERE period >= DATE '{O.evaluation_start}'),
worked AS (""" + " UNION ALL ".join(
    f"SELECT 'B{i}' AS rung, period, rank_b{i} AS pos, count(*) OVER (PARTITION BY period) AS population, alert_id, attempts, types, tp, unattr FROM eval QUALIFY rank_b{i} <= {O.k}" for i in range(4)
) + ")"
_UNIVERSE = f"""
live AS (SELECT DISTINCT attempt_id, typology FROM labels_ WHERE attempt_id IS NOT NULL AND period >= DATE '{O.evaluation_start}'),
universe AS (SELECT l.*, e.x IS NOT NULL AS surfaced FROM live l LEFT JOIN (SELECT DISTINCT unnest(attempts) AS x FROM eval) e ON l.attempt_id = e.x)"""
_POOLED = """
pooled AS (SELECT rung, count(*) AS worked, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives, CAST(sum(CAST(tp AS INT)) AS DOUBLE) / count(*) AS precision FROM worked GROUP BY 1)"""

_BASE = "WITH" + _LEDGER
_TO_ROWS = _BASE + "," + _RULES + "," + _ROWS
_TO_ALERTS = _TO_ROWS + "," + _ALERTS
_TO_PREPARED = _TO_ALERTS + "," + _LABELS + "," + _PREPARED
_TO_RATES = _TO_PREPARED + "," + _RATES
_TO_WORKED = _TO_RATES + "," + _RANKED
_TO_UNIVERSE = _TO_WORKED + "," + _UNIVERSE
_TO_POOLED = _TO_WORKED + "," + _POOLED
_IDS = "array_to_string(ids, ',') AS txn_ids"
_SUPPORT = "(VALUES " + ", ".join(f"('{r}', {repr(t) if t else 'NULL'})" for r in RULES for t in (RULE_SUPPORT[r] or (None,))) + ") b(rule_id, typology)"
_TARGETS = """
targets AS (
  SELECT period, len(list_distinct(flatten(list(attempts)))) AS attempts, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives FROM worked WHERE rung = {ref} GROUP BY 1),
firsts AS (SELECT period, x, min(pos) AS pos FROM (SELECT period, {rank} AS pos, unnest(attempts) AS x FROM {of}) GROUP BY 1, 2),
kth AS (SELECT period, pos, row_number() OVER (PARTITION BY period ORDER BY pos, x) AS k FROM firsts),
tps AS (SELECT period, {rank} AS pos, row_number() OVER (PARTITION BY period ORDER BY {rank}) AS k FROM {of} WHERE tp),
deep AS (
  SELECT t.*, CASE WHEN t.attempts = 0 THEN 0 ELSE a.pos END AS attempts_depth, CASE WHEN t.true_positives = 0 THEN 0 ELSE b.pos END AS alerts_depth
  FROM targets t LEFT JOIN kth a ON a.period = t.period AND a.k = t.attempts LEFT JOIN tps b ON b.period = t.period AND b.k = t.true_positives),
volume AS (SELECT *, {k} - attempts_depth AS attempts_freed, {k} - alerts_depth AS alerts_freed, attempts = 0 AS target_was_zero FROM deep)"""
_TO_VOLUME = _TO_WORKED + "," + _TARGETS.format(ref="'B2'", rank="rank_b3", of="eval", k=O.k)
_COVER = f"""
pairs AS (SELECT period, rank_b3 AS pos, unnest(attempts) AS attempt_id, types FROM ranked),
first_find AS (SELECT period, attempt_id, min(pos) AS pos, arg_min(types, pos) AS types FROM pairs GROUP BY 1, 2),
cover AS (
  SELECT period, typology, count(*) AS surfaced, CAST(sum(CAST(pos <= {O.k} AS INT)) AS BIGINT) AS recovered, max(pos) AS deepest
  FROM (SELECT period, attempt_id, pos, unnest(types) AS typology FROM first_find) GROUP BY 1, 2)"""


def _history(side: str, own: str, other: str, of: str = "alerts", tag: str = "", cut: str = "") -> str:
    """History and period figures of one side for every alert, by comparison of days; cut trims the ledger further."""
    figures = lambda span: f"""count(t.txn_id) AS {tag}{span}_{side}_count, count(DISTINCT t.{other}) AS {tag}{span}_{side}_counterparties,
    coalesce(CAST(sum(CAST(t.amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS {tag}{span}_{side}_amount_total, coalesce(max(t.amount), 0) AS {tag}{span}_{side}_amount_max"""  # noqa: E731
    return f"""
{tag}h_{side} AS (
  SELECT a.alert_id, {figures("history")}, count(DISTINCT t.period) AS {tag}history_{side}_days
  FROM {of} a LEFT JOIN ledger t ON t.{own} = a.subject_account AND t.period < a.period{cut} GROUP BY 1),
{tag}p_{side} AS (
  SELECT a.alert_id, {figures("period")}
  FROM {of} a LEFT JOIN ledger t ON t.{own} = a.subject_account AND t.period = a.period{cut} GROUP BY 1)"""


_ENDS = {"out": ("from_account", "to_account"), "in": ("to_account", "from_account")}
_COUNTED = [f"{span}_{side}_{part}" for span in ("history", "period") for side in _ENDS for part in ("count", "counterparties", "amount_total", "amount_max")]
_SAMPLE = """
sample AS (SELECT * FROM alerts ORDER BY CAST('0x' || substr(md5('1|' || alert_id), 1, 15) AS BIGINT), alert_id LIMIT 200)"""
_TO_FEATURES = _TO_ALERTS + "," + _history("out", "from_account", "to_account") + "," + _history("in", "to_account", "from_account")


_SCORED = f"""
scores AS (SELECT a.alert_id, 100.0::DOUBLE * len(a.fired) + period_out_count + period_in_count AS score FROM alerts a JOIN p_out USING (alert_id) JOIN p_in USING (alert_id)),
scored AS (SELECT e.*, row_number() OVER (PARTITION BY period ORDER BY score DESC, first_txn_ts, alert_id) AS rank_c1 FROM eval e JOIN scores USING (alert_id)),
c1 AS (SELECT 'C1' AS rung, period, rank_c1 AS pos, count(*) OVER (PARTITION BY period) AS population, alert_id, attempts, types, tp, unattr FROM scored QUALIFY rank_c1 <= {O.k}),
five AS (SELECT * FROM worked UNION ALL SELECT * FROM c1),
pooled5 AS (SELECT rung, count(*) AS worked, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives, CAST(sum(CAST(tp AS INT)) AS DOUBLE) / count(*) AS precision FROM five GROUP BY 1),
best AS (SELECT rung FROM pooled5 WHERE rung <> 'C1' ORDER BY precision DESC, rung LIMIT 1)"""
_TO_SCORED = _TO_WORKED + "," + _history("out", *_ENDS["out"]) + "," + _history("in", *_ENDS["in"]) + "," + _SCORED
_TO_SCORED_VOLUME = _TO_SCORED + "," + _TARGETS.format(ref="(SELECT rung FROM best)", rank="rank_c1", of="scored", k=O.k)
_VOLUME = " SELECT CAST(period AS TIMESTAMP) AS period_start, attempts, true_positives, attempts_depth, alerts_depth, attempts_freed, alerts_freed, target_was_zero FROM volume"
_REDUCTION = f" SELECT CAST(sum(alerts_freed) AS DOUBLE) / ({O.k} * count(alerts_depth)) AS reduction FROM volume"
_AT = lambda q: f"l[CAST(floor({q}::DOUBLE * (len(l) - 1)) AS BIGINT) + 1]"
_REPLAY = _BASE + """,
rail AS (
  SELECT txn_id, ts, from_account, to_account, amount, currency, CASE format WHEN 'purchase' THEN 'Cash' WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'Credit Card' ELSE 'Cheque' END AS format,
    format <> 'signup' AND amount >= 20 AND txn_id % 3 = 0 AS flag, row_number() OVER (ORDER BY ts, txn_id) AS g FROM ledger),
party AS (SELECT from_account FROM rail WHERE flag GROUP BY 1 HAVING count(*) >= 16 ORDER BY min(g), from_account LIMIT 1),
rails AS (SELECT count(DISTINCT format) AS c FROM (SELECT format FROM rail WHERE flag ORDER BY g LIMIT 18)),
picked AS (""" + " UNION ALL ".join(
    f"SELECT '{case}' AS case_id, row_number() OVER (ORDER BY g) AS n, txn_id, ts, from_account, to_account, amount, currency, format FROM rail WHERE {cond} QUALIFY n <= {most}"
    for case, cond, most in (
        ("sim-escalation", "flag AND from_account IN (SELECT from_account FROM party)", 16), ("sim-cash", "flag AND format = 'Cash'", 8), ("sim-mixed", "flag AND (SELECT c FROM rails) >= 3", 10),
        ("sim-ach", "NOT flag AND format = 'ACH'", 8), ("sim-ach-short", "NOT flag AND format = 'ACH'", 5), ("sim-card", "NOT flag AND format = 'Credit Card'", 8),
    )
) + """),
cases AS (SELECT case_id, n, txn_id, ts, 'Party-' || upper(substr(sha256(from_account), 1, 10)) AS from_account, 'Party-' || upper(substr(sha256(to_account), 1, 10)) AS to_account, amount, currency, format FROM picked)"""  # fmt: skip


def _features(span: str) -> str:
    cols = ", ".join(f"{span}_{side}_{part}" for side in ("out", "in") for part in ("count", "counterparties", "amount_total", "amount_max"))
    means = ", ".join(f"coalesce({span}_{side}_amount_total / nullif({span}_{side}_count, 0), 0) AS {span}_{side}_amount_mean" for side in ("out", "in"))
    t = span[0]
    extra = ", CAST(history_out_days AS BIGINT) AS history_active_periods" if span == "history" else ""
    return _TO_FEATURES + f" SELECT alert_id, {cols}, {means}{extra} FROM {t}_out JOIN {t}_in USING (alert_id)"


_DAILY = """, sides AS (
  SELECT 'out' AS side, from_account AS account, from_bank AS bank, to_account AS party, period AS day, amount FROM ledger
  UNION ALL SELECT 'in', to_account, to_bank, from_account, period, amount FROM ledger),
firsts AS (SELECT side, account, day, count(*) AS f FROM (SELECT side, account, party, min(day) AS day FROM sides GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
SELECT side, account, min(bank) AS bank, day, count(*) AS c, count(DISTINCT party) AS p, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS s, max(amount) AS x, coalesce(max(f), 0) AS f
FROM sides LEFT JOIN firsts USING (side, account, day) GROUP BY side, account, day"""


def _quantities() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, (n, *about)))})" for n, about in QUANTITIES.items())


def sql() -> dict[str, str]:
    out = {
        "daily_activity": _BASE + _DAILY,
        "daily_extended": _BASE + _DAILY,
        "ledger_load": _BASE + " SELECT txn_id, ts, from_account, to_account, from_bank, to_bank, amount, currency, format, period FROM ledger",
        "bank_jurisdictions": _BASE + " SELECT bank, jurisdiction FROM juris",
        "r1_structuring": _TO_ROWS + f" SELECT subject_account, period, n, total, {_IDS} FROM r1",
        "r2_rapid_movement": _TO_ROWS + f" SELECT subject_account, period, n, max_amount, {_IDS} FROM r2",
        "r3_fan_in": _TO_ROWS + f" SELECT subject_account, period, n, total, {_IDS} FROM r3",
        "r4_fan_out": _TO_ROWS + f" SELECT subject_account, period, n, total, {_IDS} FROM r4",
        "r5_round_amounts": _TO_ROWS + f" SELECT subject_account, period, n, total, {_IDS} FROM r5",
        "r6_dormant_active": _TO_ROWS + f" SELECT subject_account, period, n, prior, {_IDS} FROM r6",
        "r7_corridor": _TO_ROWS + f" SELECT subject_account, period, n, jurisdictions, total, {_IDS} FROM r7",
        "r8_peer_velocity": _TO_ROWS + f" SELECT subject_account, period, n, own_mean, peer_mean, prior_periods, {_IDS} FROM r8",
        "rule_rows": _TO_ROWS + f" SELECT subject_account, period, rule_id, n, {_IDS} FROM rule_rows",
        "rule_report": _TO_ROWS + """, active AS (SELECT count(*) AS c FROM (SELECT from_account, period FROM ledger UNION SELECT to_account, period FROM ledger))
SELECT rule_id, count(*) AS n_rows, count(DISTINCT subject_account) AS n_subjects, CAST(sum(len(ids)) AS BIGINT) AS n_txns,
  CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT period) FROM ledger) AS rows_per_period, CAST(count(*) AS DOUBLE) / (SELECT c FROM active) AS base_rate FROM rule_rows GROUP BY 1""",
        "alert_volume": _TO_ROWS + " SELECT period, count(DISTINCT subject_account) AS n_alerts, count(*) AS n_rows FROM rule_rows GROUP BY 1",
        "mean_alerts": _TO_ROWS + " SELECT avg(c) AS mean_alerts FROM (SELECT period, count(DISTINCT subject_account) AS c FROM rule_rows GROUP BY 1)",
        "rule_overlap": _TO_ROWS + " SELECT n_rules, count(*) AS n_alerts FROM (SELECT count(DISTINCT rule_id) AS n_rules FROM rule_rows GROUP BY subject_account, period) GROUP BY 1",
        "excluded_by_window": _BASE + " SELECT count(*) FILTER (period NOT BETWEEN DATE '2024-01-04' AND DATE '2024-01-20') AS n_excluded FROM ledger",
        "alerts": _TO_ALERTS + f" SELECT alert_id, subject_account, CAST(period AS TIMESTAMP) AS period_start, CAST(period + 1 AS TIMESTAMP) AS period_end, rules AS fired_rules, {_IDS}, '{ENGINE}' AS engine_version, '{P.digest()}' AS param_set_hash FROM alerts",
        "period_index": _TO_ALERTS + " SELECT period, count(*) AS n_alerts, CAST(sum(len(fired)) AS BIGINT) AS n_rules, CAST(sum(len(ids)) AS BIGINT) AS n_txns FROM alerts GROUP BY 1",
        "alert_evidence": _TO_ALERTS + """, q AS (
  SELECT subject_account, period, 'R1' AS rule_id, 'count' AS name, CAST(n AS DOUBLE) AS value FROM r1 UNION ALL SELECT subject_account, period, 'R1', 'total', total FROM r1
  UNION ALL SELECT subject_account, period, 'R2', 'pairs', n FROM r2 UNION ALL SELECT subject_account, period, 'R2', 'largest_pass_through', max_amount FROM r2
  UNION ALL SELECT subject_account, period, 'R3', 'counterparties', n FROM r3 UNION ALL SELECT subject_account, period, 'R3', 'total', total FROM r3
  UNION ALL SELECT subject_account, period, 'R4', 'counterparties', n FROM r4 UNION ALL SELECT subject_account, period, 'R4', 'total', total FROM r4
  UNION ALL SELECT subject_account, period, 'R5', 'count', n FROM r5 UNION ALL SELECT subject_account, period, 'R5', 'total', total FROM r5
  UNION ALL SELECT subject_account, period, 'R6', 'count', n FROM r6 UNION ALL SELECT subject_account, period, 'R6', 'prior_count', prior FROM r6
  UNION ALL SELECT subject_account, period, 'R7', 'count', n FROM r7 UNION ALL SELECT subject_account, period, 'R7', 'total', total FROM r7 UNION ALL SELECT subject_account, period, 'R7', 'jurisdictions', jurisdictions FROM r7
  UNION ALL SELECT subject_account, period, 'R8', 'count', n FROM r8 UNION ALL SELECT subject_account, period, 'R8', 'prior_periods', prior_periods FROM r8
  UNION ALL SELECT subject_account, period, 'R8', 'own_mean', own_mean FROM r8 UNION ALL SELECT subject_account, period, 'R8', 'peer_mean', peer_mean FROM r8)
SELECT alert_id, rule_id, name, value FROM q JOIN alerts USING (subject_account, period)""",
        "features_history": _features("history"),
        "features_period": _features("period"),
        "features_shape": _TO_ALERTS + f""" SELECT alert_id, coalesce(stddev_samp(hour(ts)), 0) AS period_hour_spread, coalesce(avg(CAST(CAST(round(amount * 100) AS BIGINT) % 100 = 0 AS INT)), 0) AS period_whole_dollar_share,
  coalesce(avg(CAST(format IN ({_FORMATS}) AS INT)), 0) AS period_corridor_format_share, coalesce(avg(CAST(from_bank <> to_bank AS INT)), 0) AS period_cross_bank_share, count(DISTINCT currency) AS period_currencies
FROM alerts a LEFT JOIN ledger t ON t.from_account = a.subject_account AND t.period = a.period GROUP BY 1""",
        "features_flags": _TO_FEATURES + " SELECT alert_id, len(fired) AS fired_rule_count, len(ids) AS contributing_transactions, "
        + ", ".join(f"CAST(list_contains(fired, '{r}') AS INT) AS fired_{r.lower()}" for r in RULES)
        + """, period_out_count / greatest(history_out_count / greatest(history_out_days, 1), 0.001::DOUBLE) AS period_over_history_rate, period_out_counterparties / greatest(period_out_count, 1) AS period_counterparty_ratio,
  period_out_amount_total / greatest(history_out_amount_total, 1.0::DOUBLE) AS period_over_history_amount FROM alerts JOIN h_out USING (alert_id) JOIN p_out USING (alert_id)""",
        "leakage_gate": _TO_ALERTS + "," + _SAMPLE + "," + ",".join(_history(side, *ends, of="sample", tag=tag, cut=cut) for tag, cut in (("", ""), ("cut_", " AND t.ts < CAST(a.period + 1 AS TIMESTAMP)")) for side, ends in _ENDS.items())
        + """, pairs AS (SELECT * FROM """ + " JOIN ".join(f"{tag}{span}_{side} {'' if (tag, span, side) == ('', 'h', 'out') else 'USING (alert_id)'}" for tag in ("", "cut_") for span in "hp" for side in _ENDS) + """)
SELECT (SELECT CAST(count(*) AS INT) FROM sample) AS sampled, CAST(""" + " + ".join(f"max(CAST({c} <> cut_{c} AS INT))" for c in _COUNTED) + """ AS INT) AS leaking_features FROM pairs""",
        "leakage_caught": _TO_ALERTS + "," + _SAMPLE + """, ever AS (SELECT a.alert_id, count(t.txn_id) AS n, count(t.txn_id) FILTER (t.ts < CAST(a.period + 1 AS TIMESTAMP)) AS cut FROM sample a LEFT JOIN ledger t ON t.from_account = a.subject_account GROUP BY 1)
SELECT 'ever_out_count' AS feature, count(*) AS differing FROM ever WHERE n <> cut HAVING count(*) > 0""",
        "labels": _BASE + "," + _LABELS + " SELECT txn_id, period, attempt_id, typology FROM labels_",
        "prepared": _TO_PREPARED + """ SELECT alert_id, subject_account, CAST(period AS TIMESTAMP) AS period_start, array_to_string(fired, ',') AS fired_rules, first_txn_ts, alert_amount, laundering_transactions,
  array_to_string(attempts, ',') AS attempt_ids, array_to_string(types, ',') AS typologies, tp AS is_true_positive, unattr AS unattributed_only FROM prepared""",
        "evaluation_periods": _TO_PREPARED + f" SELECT DISTINCT CAST(period AS TIMESTAMP) AS period_start FROM prepared WHERE period >= DATE '{O.evaluation_start}'",
        "population_base_rate": _TO_WORKED + " SELECT count(*) AS alerts, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives, avg(CAST(tp AS INT)) AS base_rate FROM eval",
        "rule_hit_rates": _TO_RATES + " SELECT CAST(period AS TIMESTAMP) AS period_start, rule_id, alerts, hits, observed, pooled, hit_rate FROM smooth",
        "worked_queue": _TO_WORKED + " SELECT rung, CAST(period AS TIMESTAMP) AS period_start, pos AS queue_position, population AS period_alerts, alert_id, tp AS is_true_positive, unattr AS unattributed_only FROM worked",
        "precision_per_period": _TO_WORKED + " SELECT rung, CAST(period AS TIMESTAMP) AS period_start, count(*) AS worked, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives, any_value(population) AS population, CAST(sum(CAST(tp AS INT)) AS DOUBLE) / count(*) AS precision FROM worked GROUP BY 1, 2",
        "precision_pooled": _TO_POOLED + " SELECT * FROM pooled",
        "attempt_universe": _TO_UNIVERSE + " SELECT attempt_id, typology, surfaced FROM universe",
        "typology_recall": _TO_UNIVERSE + """, got AS (SELECT DISTINCT rung, unnest(attempts) AS attempt_id FROM worked)
SELECT r.rung, u.typology, count(*) AS attempts, CAST(sum(CAST(surfaced AS INT)) AS BIGINT) AS surfaced, count(g.attempt_id) AS recovered, CAST(count(g.attempt_id) AS DOUBLE) / count(*) AS recall,
  CAST(count(g.attempt_id) AS DOUBLE) / greatest(sum(CAST(surfaced AS INT)), 1) AS recall_of_surfaced
FROM universe u CROSS JOIN (SELECT DISTINCT rung FROM worked) r LEFT JOIN got g ON g.rung = r.rung AND g.attempt_id = u.attempt_id GROUP BY 1, 2""",
        "unattributed": _TO_WORKED + " SELECT rung, CAST(sum(CAST(unattr AS INT)) AS BIGINT) AS reached, (SELECT CAST(sum(CAST(unattr AS INT)) AS BIGINT) FROM eval) AS population FROM worked GROUP BY 1",
        "rule_support": _TO_UNIVERSE + f""" SELECT rule_id, count(typology) > 0 AS supported, coalesce(string_agg(typology, ',' ORDER BY typology), '') AS typologies, CAST(coalesce(sum(n), 0) AS BIGINT) AS attempts
FROM {_SUPPORT} LEFT JOIN (SELECT typology, count(*) AS n FROM universe GROUP BY 1) USING (typology) GROUP BY 1""",
        "lift": _TO_POOLED + " SELECT a.rung, b.rung AS over, CASE WHEN b.precision = 0 THEN 'inf'::DOUBLE ELSE a.precision / b.precision END AS lift FROM pooled a JOIN pooled b ON a.rung <> b.rung",
        "reference_rung": _TO_POOLED + " SELECT rung, precision FROM pooled ORDER BY precision DESC, rung LIMIT 1",
        "unsmoothed_b3": _TO_RATES + f""", raw_prio AS (
  SELECT p.alert_id, max(coalesce((s.hits + 0.0::DOUBLE * s.pooled) / nullif(s.alerts + 0.0::DOUBLE, 0), 0)) AS priority FROM (SELECT alert_id, period, unnest(fired) AS rule_id FROM prepared) p JOIN rates s USING (period, rule_id) GROUP BY 1)
SELECT 'B3-unsmoothed' AS rung, alert_id, row_number() OVER (PARTITION BY period ORDER BY priority DESC, first_txn_ts, alert_id) AS queue_position FROM prepared JOIN raw_prio USING (alert_id)
WHERE period >= DATE '{O.evaluation_start}' QUALIFY queue_position <= {O.k}""",
        "volume_reduction": _TO_VOLUME + _VOLUME,
        "pooled_reduction": _TO_VOLUME + _REDUCTION,
        "bootstrap_mean": _TO_WORKED + f""", el AS (SELECT rung, row_number() OVER (PARTITION BY rung ORDER BY period, pos) - 1 AS i, count(*) OVER (PARTITION BY rung) AS size, CAST(tp AS INT) AS v FROM worked),
dr AS (SELECT rung, s, CAST('0x' || substr(md5('{O.seed}|' || s || '|' || i), 1, 15) AS BIGINT) % size AS i FROM el CROSS JOIN range(1000) t(s)),
ms AS (SELECT rung, s, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM dr JOIN el USING (rung, i) GROUP BY 1, 2),
ls AS (SELECT rung, list_sort(list(m)) AS l FROM ms GROUP BY 1)
SELECT rung, (SELECT CAST(sum(v) AS DOUBLE) / count(*) FROM el e WHERE e.rung = ls.rung) AS mean, CAST(len(l) AS BIGINT) AS samples, l[CAST(floor(0.025::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS low, l[CAST(floor(0.975::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS high FROM ls""",
        "bootstrap_lift": _TO_WORKED + f""", per AS (SELECT period, count(*) FILTER (rung = 'B3') AS aw, CAST(sum(CAST(tp AS INT)) FILTER (rung = 'B3') AS BIGINT) AS a_hits, count(*) FILTER (rung = 'B0') AS bw, CAST(sum(CAST(tp AS INT)) FILTER (rung = 'B0') AS BIGINT) AS b_hits FROM worked GROUP BY 1),
el AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS size FROM per),
dr AS (SELECT s, CAST('0x' || substr(md5('{O.seed}|' || s || '|' || i), 1, 15) AS BIGINT) % size AS i FROM el CROSS JOIN range(1000) t(s)),
ms AS (SELECT s, (CAST(sum(a_hits) AS DOUBLE) / sum(aw)) / nullif(CAST(sum(b_hits) AS DOUBLE) / sum(bw), 0) AS m FROM dr JOIN el USING (i) GROUP BY 1),
ls AS (SELECT list_sort(list(m) FILTER (m IS NOT NULL)) AS l FROM ms)
SELECT CAST(len(l) AS BIGINT) AS samples, l[CAST(floor(0.025::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS low, l[CAST(floor(0.975::DOUBLE * (len(l) - 1)) AS BIGINT) + 1] AS high FROM ls""",
        "spearman_b2_b3": _TO_WORKED + " SELECT CAST(period AS TIMESTAMP) AS period_start, round(corr(rank_b2, rank_b3), 9) AS rho FROM ranked GROUP BY 1",
        "coverage_at_depth": _TO_WORKED + "," + _COVER + " SELECT CAST(period AS TIMESTAMP) AS period_start, typology, surfaced, recovered, deepest FROM cover",
        "loses_coverage_first": _TO_WORKED + "," + _COVER + " SELECT CAST(period AS TIMESTAMP) AS period_start, typology, deepest FROM cover QUALIFY row_number() OVER (PARTITION BY period ORDER BY deepest DESC, typology) = 1",
        "queue_view": _TO_WORKED + " SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_b3 AS position FROM ranked WHERE list_contains(types, 'CYCLE')",
        "best_and_worst": _TO_VOLUME + f", v AS (SELECT period, alerts_freed AS f FROM volume WHERE alerts_freed IS NOT NULL) SELECT (SELECT CAST(period AS TIMESTAMP) FROM v ORDER BY f DESC, period LIMIT 1) AS best, (SELECT CAST(period AS TIMESTAMP) FROM v ORDER BY f, period LIMIT 1) AS worst, count(*) FILTER (f < 0) AS negative FROM v",
        "bounded_transactions": _TO_ALERTS + """ SELECT alert_id, row_number() OVER (PARTITION BY alert_id ORDER BY ts, txn_id) AS n, count(*) OVER (PARTITION BY alert_id) AS true_count, txn_id, ts,
  'Party-' || upper(substr(sha256(from_account), 1, 10)) AS sender, 'Party-' || upper(substr(sha256(to_account), 1, 10)) AS receiver, amount, currency, format
FROM (SELECT alert_id, unnest(ids) AS txn_id FROM alerts) JOIN ledger USING (txn_id) QUALIFY n <= 8""",
        "rule_table": _TO_UNIVERSE + f""", vol AS (SELECT rule_id, count(*) AS store_alerts, CAST(sum(CAST(period = DATE '2024-01-10' AS INT)) AS BIGINT) AS period_alerts FROM (SELECT period, unnest(fired) AS rule_id FROM alerts) GROUP BY 1),
sup AS (SELECT rule_id, count(typology) > 0 AS supported, coalesce(string_agg(typology, ',' ORDER BY typology), '') AS typologies, CAST(coalesce(sum(n), 0) AS BIGINT) AS attempts
  FROM {_SUPPORT} LEFT JOIN (SELECT typology, count(*) AS n FROM universe GROUP BY 1) USING (typology) GROUP BY 1)
SELECT sup.*, coalesce(store_alerts, 0) AS store_alerts, coalesce(period_alerts, 0) AS period_alerts FROM sup LEFT JOIN vol USING (rule_id)""",
        "funnel": _TO_UNIVERSE + """, got AS (SELECT rung, count(*) AS recovered FROM (SELECT DISTINCT rung, unnest(attempts) AS attempt_id FROM worked) JOIN universe USING (attempt_id) GROUP BY 1)
SELECT r.rung, coalesce(recovered, 0) AS recovered, (SELECT count(*) FROM universe) AS live, (SELECT count(*) FILTER (surfaced) FROM universe) AS surfaced FROM (SELECT DISTINCT rung FROM worked) r LEFT JOIN got USING (rung)""",
        "order_c1": _TO_SCORED + " SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_c1 AS position FROM scored",
        "scored_queue": _TO_SCORED + " SELECT rung, CAST(period AS TIMESTAMP) AS period_start, pos AS queue_position, population AS period_alerts, alert_id, tp AS is_true_positive, unattr AS unattributed_only FROM c1",
        "scored_precision": _TO_SCORED + " SELECT * FROM pooled5",
        "scored_precision_per_period": _TO_SCORED + " SELECT rung, CAST(period AS TIMESTAMP) AS period_start, count(*) AS worked, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS true_positives, any_value(population) AS population, CAST(sum(CAST(tp AS INT)) AS DOUBLE) / count(*) AS precision FROM c1 GROUP BY 1, 2",
        "scored_lift": _TO_SCORED + " SELECT a.rung, b.rung AS over, CASE WHEN b.precision = 0 THEN 'inf'::DOUBLE ELSE a.precision / b.precision END AS lift FROM pooled5 a JOIN pooled5 b ON a.rung <> b.rung WHERE a.rung = 'C1'",
        "scored_typology_recall": _TO_SCORED + "," + _UNIVERSE + """, got AS (SELECT DISTINCT unnest(attempts) AS attempt_id FROM c1)
SELECT 'C1' AS rung, u.typology, count(*) AS attempts, CAST(sum(CAST(surfaced AS INT)) AS BIGINT) AS surfaced, count(g.attempt_id) AS recovered, CAST(count(g.attempt_id) AS DOUBLE) / count(*) AS recall,
  CAST(count(g.attempt_id) AS DOUBLE) / greatest(sum(CAST(surfaced AS INT)), 1) AS recall_of_surfaced FROM universe u LEFT JOIN got g ON g.attempt_id = u.attempt_id GROUP BY 2""",
        "scored_unattributed": _TO_SCORED + " SELECT rung, CAST(sum(CAST(unattr AS INT)) AS BIGINT) AS reached, (SELECT CAST(sum(CAST(unattr AS INT)) AS BIGINT) FROM eval) AS population FROM c1 GROUP BY 1",
        "scored_volume_reduction": _TO_SCORED_VOLUME + _VOLUME,
        "scored_reduction": _TO_SCORED_VOLUME + _REDUCTION,
        "scored_gate": _TO_SCORED + f""", per AS (SELECT period, count(*) FILTER (rung = 'C1') AS aw, CAST(sum(CAST(tp AS INT)) FILTER (rung = 'C1') AS BIGINT) AS a_hits, count(*) FILTER (rung = (SELECT rung FROM best)) AS bw, CAST(sum(CAST(tp AS INT)) FILTER (rung = (SELECT rung FROM best)) AS BIGINT) AS b_hits FROM five GROUP BY 1),
el AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS size FROM per),
dr AS (SELECT s, CAST('0x' || substr(md5('{O.seed}|' || s || '|' || i), 1, 15) AS BIGINT) % size AS i FROM el CROSS JOIN range(1000) t(s)),
ms AS (SELECT s, (CAST(sum(a_hits) AS DOUBLE) / sum(aw)) / nullif(CAST(sum(b_hits) AS DOUBLE) / sum(bw), 0) AS m FROM dr JOIN el USING (i) GROUP BY 1),
ls AS (SELECT list_sort(list(m) FILTER (m IS NOT NULL)) AS l FROM ms),
g AS (SELECT b.rung AS reference_rung, a.precision / nullif(b.precision, 0) AS lift, {_AT(0.025)} AS low, {_AT(0.975)} AS high FROM pooled5 a JOIN pooled5 b ON a.rung = 'C1' AND b.rung = (SELECT rung FROM best) CROSS JOIN ls)
SELECT *, lift >= {O.gate} AS point_passed, coalesce(low, 0) > 1 AS interval_passed, lift >= {O.gate} AND coalesce(low, 0) > 1 AS passed FROM g""",
        "recall_intervals": _TO_SCORED + "," + _UNIVERSE + f""", got AS (SELECT DISTINCT unnest(attempts) AS attempt_id FROM c1),
el AS (SELECT typology, row_number() OVER (PARTITION BY typology ORDER BY u.attempt_id) - 1 AS i, count(*) OVER (PARTITION BY typology) AS size, CAST(g.attempt_id IS NOT NULL AS INT) AS v FROM universe u LEFT JOIN got g ON g.attempt_id = u.attempt_id),
dr AS (SELECT typology, s, CAST('0x' || substr(md5('{O.seed}|' || s || '|' || i), 1, 15) AS BIGINT) % size AS i FROM el CROSS JOIN range(1000) t(s)),
ms AS (SELECT typology, s, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM dr JOIN el USING (typology, i) GROUP BY 1, 2),
ls AS (SELECT typology, list_sort(list(m)) AS l FROM ms GROUP BY 1)
SELECT typology, (SELECT CAST(sum(v) AS DOUBLE) / count(*) FROM el e WHERE e.typology = ls.typology) AS mean, CAST(len(l) AS BIGINT) AS samples, {_AT(0.025)} AS low, {_AT(0.975)} AS high FROM ls""",
        "contribution_split": _TO_SCORED + """ SELECT b.true_positives AS base_tp, c.true_positives AS top_tp, c.true_positives - b.true_positives AS gain, CAST(b.true_positives AS DOUBLE) / nullif(c.true_positives, 0) AS share,
  (c.precision - b.precision) * 100 AS points FROM pooled5 b JOIN pooled5 c ON b.rung = 'B3' AND c.rung = 'C1'""",
        "ranking_groups": _TO_PREPARED + """ SELECT CAST(period AS TIMESTAMP) AS period_start, count(*) AS alerts, CAST(sum(CAST(tp AS INT)) AS BIGINT) AS positives,
  CAST(sum(CAST(tp AS INT)) * (count(*) - sum(CAST(tp AS INT))) AS BIGINT) AS pairs FROM prepared WHERE period < DATE '2024-01-15' GROUP BY 1""",
        "training_frame": _TO_PREPARED + "," + _history("out", *_ENDS["out"]) + """ SELECT p.alert_id, CAST(p.period AS TIMESTAMP) AS period_start, CAST(tp AS DOUBLE) AS label, len(fired) AS fired_rule_count, period_out_count
FROM prepared p JOIN p_out USING (alert_id) WHERE p.period < DATE '2024-01-15'""",
        "period_attempts": _TO_PREPARED + """ SELECT l.attempt_id, l.typology, e.x IS NOT NULL AS surfaced FROM (SELECT DISTINCT attempt_id, typology FROM labels_ WHERE attempt_id IS NOT NULL AND period = DATE '2024-01-10') l
LEFT JOIN (SELECT DISTINCT unnest(attempts) AS x FROM prepared WHERE period = DATE '2024-01-10') e ON l.attempt_id = e.x""",
        "typology_table": _TO_UNIVERSE + f""", day_live AS (SELECT l.*, e.x IS NOT NULL AS surfaced FROM (SELECT DISTINCT attempt_id, typology FROM labels_ WHERE attempt_id IS NOT NULL AND period = DATE '2024-01-10') l
  LEFT JOIN (SELECT DISTINCT unnest(attempts) AS x FROM prepared WHERE period = DATE '2024-01-10') e ON l.attempt_id = e.x)
SELECT t.typology, (SELECT count(*) FROM day_live d WHERE d.typology = t.typology) AS period_attempts, (SELECT count(*) FILTER (surfaced) FROM day_live d WHERE d.typology = t.typology) AS period_surfaced,
  (SELECT count(*) FROM universe u WHERE u.typology = t.typology) AS evaluation_attempts, (SELECT count(*) FILTER (surfaced) FROM universe u WHERE u.typology = t.typology) AS evaluation_surfaced
FROM (SELECT unnest({_NAMES}) AS typology) t""",
        "replay_cases": _REPLAY + " SELECT * FROM cases",
        "case_list": _REPLAY + " SELECT case_id, count(*) AS n_txns, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM cases GROUP BY 1",
        "case_timeline": _REPLAY + " SELECT * FROM cases WHERE case_id = 'sim-mixed' AND format = 'Cash' ORDER BY n LIMIT 3",
        "case_evidence": _REPLAY + """ SELECT case_id, 'replay' AS kind, 'A fixed replay of ' || count(*) || ' synthetic transactions.' AS statement FROM cases GROUP BY 1
UNION ALL SELECT DISTINCT case_id, 'boundary', 'Scores and explanations are computed beforehand; reading trains and stores nothing.' FROM cases""",
        "topology": _REPLAY + """, seen AS (SELECT case_id, party, min(o) AS o FROM (SELECT case_id, from_account AS party, 2 * n AS o FROM cases UNION ALL SELECT case_id, to_account, 2 * n + 1 FROM cases) GROUP BY 1, 2),
node AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o) AS node FROM seen QUALIFY node <= 18)
SELECT c.case_id, a.node AS from_node, b.node AS to_node, count(*) AS payments, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM cases c JOIN node a ON a.case_id = c.case_id AND a.party = c.from_account JOIN node b ON b.case_id = c.case_id AND b.party = c.to_account GROUP BY 1, 2, 3""",
        "queue": _TO_WORKED + f" SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_b2 AS position, rank_b2 <= {O.k} AS worked FROM ranked",
        "alert_detail": _TO_WORKED + " SELECT alert_id, subject_account, CAST(period AS TIMESTAMP) AS period_start, rank_b1 AS position FROM ranked WHERE alert_id = (SELECT min(alert_id) FROM alerts)",
        "capacity": _TO_ALERTS + " SELECT period, count(*) AS alerts, greatest(1, least(37, count(*))) AS depth FROM alerts GROUP BY 1",
        "queue_view_unattributed": _TO_WORKED + " SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_b1 AS position FROM ranked WHERE unattr",
        "queue_view_disposition": _TO_WORKED + """, latest AS (SELECT alert_id, arg_max(CASE WHEN rung IN ('B1', 'B3') AND tp THEN 'escalated' ELSE 'closed' END, rung) AS disposition FROM worked GROUP BY 1)
SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_b2 AS position FROM ranked JOIN latest USING (alert_id) WHERE disposition = 'escalated'""",
        "daily_counts": "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    }
    for i in range(4):
        out[f"order_b{i}"] = _TO_WORKED + f" SELECT CAST(period AS TIMESTAMP) AS period_start, alert_id, rank_b{i} AS position FROM ranked"
    out["described_evidence"] = f"SELECT e.*, label, unit FROM ({out['alert_evidence']}) e JOIN (VALUES {_quantities()}) v(name, label, unit) USING (name)"
    return out
