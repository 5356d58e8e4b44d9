"""SQL twins of ``bindings.increments``."""

from __future__ import annotations

from bindings.increments import STAMP
from bindings.oracles import EVENT_FEATURES, PER_DATE, SCORES, TXN, distribution, kpis, profile
from ledgerwatch.operators.rollup import BINS

_PERIODS = (
    ("day", "date_trunc('day', event_timestamp)"),
    ("week", "date_trunc('week', event_timestamp)"),
    ("all", "TIMESTAMP '2024-01-01'"),
)
_ROLLUP = " UNION ALL ".join(
    f"""
SELECT '{span}' AS span, model_version, {period}::TIMESTAMP AS period, count(*) AS total_transactions,
  CAST(sum(prediction) AS BIGINT) AS predicted_frauds,
  round(sum(CASE WHEN prediction = 1 THEN "Amount" ELSE 0 END), 6) AS suspicious_amount,
  round(avg(fraud_score), 12) AS avg_fraud_score,
  round(CAST(sum(prediction) AS DOUBLE) / count(*), 12) AS predicted_fraud_rate,
  round(least(floor(quantile_disc(fraud_score, 0.95) * {BINS}), {BINS - 1}) / {BINS}, 12) AS quantile_low,
  round((least(floor(quantile_disc(fraud_score, 0.95) * {BINS}), {BINS - 1}) + 1) / {BINS}, 12) AS quantile_high
FROM halves GROUP BY ALL"""
    for span, period in _PERIODS
)

_COLUMNS = ("event_id", "transaction_id", "event_time", *EVENT_FEATURES, "Class")
_QUALITY = " UNION ALL ".join([*profile("events", "rows_", _COLUMNS), distribution("events", "rows_")])
QUALITY = f"""WITH {TXN},
rows_ AS (SELECT event_id, transaction_id, event_time, "Time", CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, k, "Amount", "Class" FROM txn)
SELECT *, '{STAMP}' AS created_at FROM ({_QUALITY})"""


def increment_oracles() -> dict[str, str]:
    sqls = {
        "kpi_rollup": f"""WITH {SCORES},
halves AS (SELECT * REPLACE (CASE WHEN label = 1 THEN 'second' ELSE 'first' END AS model_version) FROM scores)
{_ROLLUP}""",
        "model_in_force": f"""WITH {SCORES},
versions(model_version, in_force, since) AS (VALUES
  ('model-0', 0.5::DOUBLE, TIMESTAMP '2024-01-03 04:30:00'), ('model-2', 0.4::DOUBLE, TIMESTAMP '2024-01-11 12:30:00'),
  ('model-3', 0.35::DOUBLE, TIMESTAMP '2024-01-11 13:30:00'), ('model-4', 0.3::DOUBLE, TIMESTAMP '2024-01-24 00:30:00'))
SELECT transaction_id, event_timestamp, versions.model_version, in_force, fraud_score >= in_force AS alerted
FROM scores ASOF LEFT JOIN versions ON event_timestamp >= since""",
        "silver_advance": f"""WITH {TXN},
raw AS (SELECT *, off % 10 = 0 AS late, ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-15' AS early,
  CAST(ts + INTERVAL 1 HOUR AS DATE) AS arrived FROM txn),
opened AS (
  SELECT count(DISTINCT arrived) FILTER (early AND NOT late) AS opened_1, count(DISTINCT arrived) FILTER (NOT early AND NOT late) AS opened_2,
    count(DISTINCT arrived) FILTER (late) AS opened_3, CAST(0 AS BIGINT) AS opened_4 FROM raw)
SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS stored_rows, count(DISTINCT event_id) AS events,
  CAST(4 * count(*) AS BIGINT) AS feature_values, any_value(opened_1) AS opened_1, any_value(opened_2) AS opened_2,
  any_value(opened_3) AS opened_3, any_value(opened_4) AS opened_4
FROM raw, opened GROUP BY 1""",
        "quality_increments": QUALITY,
        "quality_of_increments": QUALITY,
        "compacted_scores": f"""WITH {SCORES},
steps AS (SELECT fraud_score, CAST('0x' || substr(transaction_id, 1, 6) AS BIGINT) % 6 AS step FROM scores)
SELECT scoring_run, CAST(step AS INTEGER) AS scoring_batch_id, count(*) AS stored_rows,
  round(sum(fraud_score) / CASE WHEN scoring_run = 'first' AND step = 2 THEN 2 ELSE 1 END, 6) AS score_sum
FROM steps, (VALUES ('first'), ('second')) AS v(scoring_run) GROUP BY scoring_run, step""",
        "catalog_layers": PER_DATE,
        "csv_exports": f"""WITH {SCORES}, hourly AS ({kpis('hour', 'scores', 15)}), daily AS ({kpis('day', 'scores', 15)})
SELECT 'fraud_scores' AS export, count(*) AS exported_rows, CAST(sum(prediction) AS BIGINT) AS alerts, round(sum(fraud_score), 6) AS measure FROM scores
UNION ALL SELECT 'fraud_kpis_hourly', count(*), CAST(sum(predicted_frauds) AS BIGINT), round(sum(p95_fraud_score), 6) FROM hourly
UNION ALL SELECT 'fraud_kpis_daily', count(*), CAST(sum(predicted_frauds) AS BIGINT), round(sum(p95_fraud_score), 6) FROM daily""",
        "replay_first_rows": f"""WITH {TXN}, numbered AS (
  SELECT event_id, row_number() OVER (ORDER BY "Time", event_id) - 1 AS row_index FROM txn)
SELECT event_id, row_index, (row_index - 100) // 200 AS replay_batch FROM numbered WHERE row_index >= 100 AND row_index < 600""",
        "arrival_stamps": "SELECT count(*) AS stamped, CAST(0 AS BIGINT) AS outside, CAST(1 AS BIGINT) AS clocks FROM events",
    }
    return {name: sql.strip() for name, sql in sqls.items()}
