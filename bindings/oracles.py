"""SQL twins of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

from bindings.views import EPOCH_MICROS, RUNS, THRESHOLD
from ledgerwatch.operators.kpi import GRAINS
from ledgerwatch.spec import DEFAULT_THRESHOLDS

CREATED_AT = "2024-02-01T00:00:00+00:00"

TXN = f"""
txn AS (
  SELECT event_id,
         sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type))
           AS transaction_id,
         ts,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS event_time,
         (epoch_us(ts) - {EPOCH_MICROS}) / 1e6 AS "Time",
         CAST(user_id AS DOUBLE) AS user_id,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         value AS "Amount",
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "Class",
         CAST(event_id % 3 AS INTEGER) AS part,
         CAST(event_id // 3 AS BIGINT) AS off
  FROM events)"""

RAW_ID = "sha256(concat_ws('|', transaction_id, CAST(part AS VARCHAR), CAST(off AS VARCHAR)))"

SCORES = (
    TXN
    + f""",
scored AS (
  SELECT transaction_id, {RAW_ID} AS raw_event_id, ts AS event_timestamp, "Amount", "Class" AS label,
         least("Amount", 500.0::DOUBLE) / 500.0::DOUBLE AS a, k / 100.0::DOUBLE AS b,
         (least("Amount", 500.0::DOUBLE) / 500.0::DOUBLE + k / 100.0::DOUBLE) / 2.0::DOUBLE AS fraud_score
  FROM txn),
scores AS (
  SELECT transaction_id, event_timestamp, "Amount", label,
         a AS rf_fraud_probability, b AS gbt_fraud_probability, fraud_score,
         CASE WHEN fraud_score >= {THRESHOLD}::DOUBLE THEN 1 ELSE 0 END AS prediction,
         {THRESHOLD}::DOUBLE AS threshold_used, 'stand-in' AS model_version,
         TIMESTAMP '2024-02-01 06:00:00' AS scored_at, 0 AS scoring_batch_id, raw_event_id
  FROM scored)"""
)

RUN_COLUMNS = "candidate_id, candidate_position, run_id, seed"
RUN_VALUES = ", ".join(
    f"('{c}', {place}, {run}, {seed}, {weight!r}::DOUBLE)" for c, place, run, seed, weight in RUNS
)
GRID_VALUES = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(DEFAULT_THRESHOLDS))

RUN_SCORES = (
    SCORES
    + f""",
runs({RUN_COLUMNS}, w) AS (VALUES {RUN_VALUES}),
run_scores AS (
  SELECT {RUN_COLUMNS}, label, event_timestamp,
         w * a + (1.0::DOUBLE - w) * b AS fraud_score
  FROM scored, runs)"""
)

LINES = f"""
line_scores AS (
  SELECT sha256(CAST(l_orderkey AS VARCHAR)) AS transaction_id,
         sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                          CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))) AS raw_event_id,
         l_orderkey, l_linenumber, l_quantity, l_shipdate AS event_timestamp,
         l_extendedprice AS "Amount",
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         (l_discount * 10.0::DOUBLE + l_quantity / 50.0::DOUBLE) / 2.0::DOUBLE AS fraud_score
  FROM lineitem),
lines AS (
  SELECT *, CASE WHEN fraud_score >= {THRESHOLD}::DOUBLE THEN 1 ELSE 0 END AS prediction
  FROM line_scores)"""


def matrices(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return f"""
sweep AS (
  SELECT {lead}CAST(g.position AS INTEGER) AS position, g.threshold,
         count(*) FILTER (fraud_score >= g.threshold AND label = 1) AS tp,
         count(*) FILTER (fraud_score >= g.threshold AND label = 0) AS fp,
         count(*) FILTER (fraud_score < g.threshold AND label = 0) AS tn,
         count(*) FILTER (fraud_score < g.threshold AND label = 1) AS fn
  FROM {source}, (VALUES {GRID_VALUES}) AS g(position, threshold)
  GROUP BY {lead}g.position, g.threshold),
pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall
  FROM sweep),
metrics AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                 ELSE 2.0 * precision * recall / (precision + recall) END AS f1_score
  FROM pr)"""


def areas(source: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
points AS (
  SELECT {lead}fraud_score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM {source} GROUP BY {lead}fraud_score),
ranked AS (
  SELECT *, sum(p) OVER (w) AS tp, sum(n) OVER (w) AS fp,
         sum(p) OVER ({over}) AS all_p, sum(n) OVER ({over}) AS all_n
  FROM points WINDOW w AS ({over}ORDER BY fraud_score DESC)),
curve AS (
  SELECT *, CAST(tp AS DOUBLE) / all_p AS recall, CAST(fp AS DOUBLE) / all_n AS fpr,
         CAST(tp AS DOUBLE) / (tp + fp) AS prec
  FROM ranked),
steps AS (
  SELECT *, lag(recall, 1, 0.0::DOUBLE) OVER (w) AS recall0, lag(fpr, 1, 0.0::DOUBLE) OVER (w) AS fpr0,
         coalesce(lag(prec) OVER (w), prec) AS prec0
  FROM curve WINDOW w AS ({over}ORDER BY fraud_score DESC)),
areas AS (
  SELECT {lead}sum((fpr - fpr0) * (recall + recall0) / 2) AS roc_auc,
         sum((recall - recall0) * (prec + prec0) / 2) AS auc_pr
  FROM steps {group})"""


def kpis(grain: str, source: str, digits: int = 12) -> str:
    time = GRAINS[grain]
    return f"""
  SELECT date_trunc('{grain}', event_timestamp)::TIMESTAMP AS {time},
         count(*) AS total_transactions,
         CAST(sum(prediction) AS BIGINT) AS predicted_frauds,
         round(sum(CASE WHEN prediction = 1 THEN "Amount" ELSE 0 END), 6) AS suspicious_amount,
         round(avg(fraud_score), {digits}) AS avg_fraud_score,
         round(quantile_disc(fraud_score, 0.95), {digits}) AS p95_fraud_score,
         round(CAST(sum(prediction) AS DOUBLE) / count(*), {digits}) AS predicted_fraud_rate
  FROM {source} GROUP BY 1"""


def chosen(eligible: str) -> str:
    return f"""
ordered AS (
  SELECT *, {eligible} AS ok FROM metrics),
chosen AS (
  SELECT * FROM ordered
  QUALIFY row_number() OVER (
    PARTITION BY {RUN_COLUMNS}
    ORDER BY ok DESC, CASE WHEN ok THEN recall ELSE f1_score END DESC,
             CASE WHEN ok THEN f1_score ELSE recall END DESC, precision DESC, position) = 1)"""


RATES = ("precision", "recall", "f1_score")
MATRIX = "tp, fp, tn, fn"


def r9(*names: str) -> str:
    return ", ".join(f"round({name}, 9) AS {name}" for name in names)


def choice(eligible: str) -> str:
    return f"""WITH {RUN_SCORES}, {matrices('run_scores', RUN_COLUMNS)}, {chosen(eligible)}
SELECT {RUN_COLUMNS}, position, round(threshold, 9) AS threshold, {MATRIX}, {r9(*RATES)} FROM chosen"""


DETERMINISTIC_RUNS = f"""{RUN_SCORES}, {matrices('run_scores', RUN_COLUMNS)},
{chosen('precision >= 0.7')}, {areas('run_scores', RUN_COLUMNS)},
done AS (SELECT * FROM chosen JOIN areas USING ({RUN_COLUMNS}))"""

CHAMPION = """
best AS (
  SELECT candidate_id, avg(auc_pr) AS mean_auc_pr, avg(f1_score) AS mean_f1,
         min(candidate_position) AS candidate_position
  FROM done GROUP BY candidate_id
  ORDER BY mean_auc_pr DESC, mean_f1 DESC, candidate_position LIMIT 1)"""

SILVER_COLUMNS = f"""transaction_id, event_time, ts AS event_timestamp, "Time", user_id, k, "Amount",
  "Class", "Class" AS label"""
ORIGIN = f"""TIMESTAMP '2024-02-01 00:00:00' AS ingestion_timestamp, 'transactions.raw' AS kafka_topic,
  part AS kafka_partition, off AS kafka_offset, 'events.parquet' AS source_file, {RAW_ID} AS raw_event_id"""
WEIGHTS = """
weights AS (
  SELECT count(*) AS total, count(*) FILTER ("Class" = 0) AS legit_count,
         count(*) FILTER ("Class" = 1) AS positive_count FROM txn)"""
WEIGHT = """CASE WHEN "Class" = 1 THEN CAST(total AS DOUBLE) / (2 * positive_count)
  ELSE CAST(total AS DOUBLE) / (2 * legit_count) END"""

PER_DATE = f"""WITH {TXN}, {WEIGHTS}
SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS stored_rows, count(DISTINCT event_id) AS events,
       CAST(4 * count(*) AS BIGINT) AS feature_values, round(sum({WEIGHT}), 6) AS weight
FROM txn, weights GROUP BY 1"""


def metric(table: str, name: str, dimension: str, value: str) -> str:
    lead = f"'{table}' AS table_name, " if table else ""
    return (
        f"SELECT {lead}'{name}' AS metric_name, {dimension} AS metric_dimension,"
        f" CAST({value} AS DOUBLE) AS metric_value"
    )


def profile(table: str, source: str, columns: tuple[str, ...], shown: str = "") -> list[str]:
    parts = [metric(shown or table, "row_count", "'*'", "count(*)") + f" FROM {source}"]
    parts += [
        metric(shown or table, "null_count", f"'{c}'", f'count(*) FILTER ("{c}" IS NULL)') + f" FROM {source}"
        for c in columns
    ]
    return parts


TABLE_COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "labels": ("doc_id", "quality", "toxic"),
    "lineitem": (
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ),
    "orders": (
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
    ),
    "pages": ("page_id", "url", "html"),
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "embeddings": ("vec_id", "embedding", "label"),
    "benchmark": ("item_id", "text"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
SCORE_COLUMNS = (
    "transaction_id",
    "event_timestamp",
    "Amount",
    "label",
    "rf_fraud_probability",
    "gbt_fraud_probability",
    "fraud_score",
    "prediction",
    "threshold_used",
    "model_version",
    "scored_at",
    "scoring_batch_id",
    "raw_event_id",
)
EVENT_FEATURES = ("Time", "user_id", "k", "Amount")
ORIGIN_COLUMNS = (
    "ingestion_timestamp",
    "kafka_topic",
    "kafka_partition",
    "kafka_offset",
    "source_file",
    "raw_event_id",
)
BRONZE_COLUMNS = ("transaction_id", "event_time", *EVENT_FEATURES, "Class", *ORIGIN_COLUMNS)
SILVER_TABLE = (
    "transaction_id",
    "event_time",
    "event_timestamp",
    *EVENT_FEATURES,
    "Class",
    "label",
    "class_weight",
    *ORIGIN_COLUMNS,
)


def repeated(table: str, source: str) -> str:
    groups = f"(SELECT transaction_id FROM {source} GROUP BY 1 HAVING count(*) > 1)"
    return metric(table, "duplicate_transaction_id", "'transaction_id'", "count(*)") + f" FROM {groups}"


def distribution(table: str, source: str) -> str:
    shown = "coalesce(CAST(\"Class\" AS VARCHAR), 'None')"
    return metric(table, "class_distribution", shown, "count(*)") + f' FROM {source} GROUP BY "Class"'


def quality() -> str:
    typed = [
        part
        for name, extra in (("silver.transactions_clean", ()), ("silver.transactions_features", ("feature_array",)))
        for part in (
            *profile(name, "typed", (*SILVER_TABLE, *extra)),
            repeated(name, "typed"),
            distribution(name, "typed"),
        )
    ]
    raw = "bronze.transactions_raw"
    parts = [
        *profile(raw, "raw", BRONZE_COLUMNS),
        repeated(raw, "raw"),
        distribution(raw, "raw"),
        metric(raw, "schema_missing_required_columns", "'none'", "0"),
        *typed,
        *profile("gold.fraud_scores", "scores", SCORE_COLUMNS),
        repeated("gold.fraud_scores", "scores"),
    ]
    return f"""WITH {SCORES},
raw AS (
  SELECT transaction_id, event_time, "Time", user_id, k, "Amount",
         CASE WHEN part <> 2 THEN "Class" END AS "Class", {ORIGIN} FROM txn),
typed AS (
  SELECT *, event_time AS event_timestamp, "Class" AS label, 1.0 AS class_weight, [1.0] AS feature_array
  FROM raw WHERE "Class" IS NOT NULL)
SELECT *, '{CREATED_AT}' AS created_at FROM ({' UNION ALL '.join(parts)})"""


SCORE_QUALITY = f"""WITH {SCORES}
SELECT *, '{CREATED_AT}' AS created_at FROM (
{' UNION ALL '.join([*profile('gold.fraud_scores', 'scores', SCORE_COLUMNS), repeated('gold.fraud_scores', 'scores')])})"""


def split(source: str, time: str, label: str) -> str:
    return f"""cuts AS (
  SELECT quantile_disc({time}, 0.6) AS c1, quantile_disc({time}, 0.8) AS c2 FROM {source}),
blocks AS (
  SELECT CASE WHEN {time} < c1 THEN 'train' WHEN {time} < c2 THEN 'validation' ELSE 'test' END AS block,
         {label} AS label FROM {source}, cuts)
SELECT block, label, count(*) AS count FROM blocks GROUP BY block, label"""


MODEL_METRICS = f"""{RUN_SCORES}, {matrices('run_scores', RUN_COLUMNS)}, {areas('run_scores', RUN_COLUMNS)},
model_metrics AS (
  SELECT candidate_id || '-' || CAST(seed AS VARCHAR) AS model_version, threshold, precision, recall,
         f1_score, {MATRIX}, auc_pr, roc_auc, '{CREATED_AT}' AS created_at
  FROM metrics JOIN areas USING ({RUN_COLUMNS}))"""


def oracle_queries() -> dict[str, str]:
    sqls = {
        "txn_id_hash": f"WITH {TXN} SELECT event_id, transaction_id FROM txn",
        "txn_id_from_values": """
SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR) || '|' ||
  CASE WHEN c_nationkey % 5 <> 0 THEN coalesce(c_mktsegment, '') ELSE '' END || '|' ||
  coalesce(c_name, '')) AS transaction_id FROM customer""",
        "raw_event_ids": f"""WITH {TXN}
SELECT transaction_id AS key, part AS partition, off AS "offset", {RAW_ID} AS raw_event_id FROM txn""",
        "event_encoding": f"""WITH {TXN}
SELECT transaction_id, 'events.parquet' AS source_file,
  'Amount,Class,Time,event_time,k,source_file,transaction_id,user_id' AS field_names,
  "Time", user_id, k, "Amount", "Class" FROM txn""",
        "bronze_parse": f"""WITH {TXN}
SELECT transaction_id, event_time, "Time", user_id, k, "Amount", "Class", {ORIGIN} FROM txn""",
        "bronze_unparsed": "SELECT doc_id, sha256(text) AS text_hash FROM documents",
        "silver_clean": f"""WITH {TXN}, {WEIGHTS}
SELECT transaction_id, event_time, ts AS event_timestamp, round("Time", 9) AS "Time", user_id, k,
  round("Amount", 9) AS "Amount", "Class", "Class" AS label, round({WEIGHT}, 9) AS class_weight, {ORIGIN}
FROM txn, weights""",
        "silver_lenient": """
SELECT l_orderkey, sha256(CAST(l_orderkey AS VARCHAR)) AS transaction_id, l_shipdate AS event_timestamp,
  0.0::DOUBLE AS "Time", l_quantity AS "Amount", CAST(l_linenumber - 1 AS DOUBLE) AS label
FROM lineitem WHERE l_linenumber IN (1, 2)""",
        "silver_rebuild": PER_DATE,
        "silver_extend": PER_DATE,
        "class_counts": f"WITH {SCORES} SELECT label, count(*) AS transactions FROM scores GROUP BY label",
        "class_weight": f"""WITH {TXN}, {WEIGHTS}
SELECT total, legit_count, positive_count, round(CAST(total AS DOUBLE) / (2 * legit_count), 9) AS legit_weight,
  round(CAST(total AS DOUBLE) / (2 * positive_count), 9) AS positive_weight FROM weights""",
        "feature_array": f"""WITH {TXN}
SELECT transaction_id, CAST(p AS INTEGER) AS position,
  CASE p WHEN 0 THEN "Time" WHEN 1 THEN user_id WHEN 2 THEN k ELSE "Amount" END AS feature
FROM txn, range(4) AS r(p)""",
        "kpi_hourly": f"WITH {SCORES} {kpis('hour', 'scores')}",
        "kpi_daily": f"WITH {SCORES} {kpis('day', 'scores')}",
        "kpi_daily_order_lines": f"WITH {LINES} {kpis('day', 'lines')}",
        "kpi_repeat_transactions": f"WITH {LINES} {kpis('day', 'lines')}",
        "kpi_listing": f"""WITH {SCORES}, hourly AS ({kpis('hour', 'scores')})
SELECT metric_window, total_transactions, predicted_frauds, predicted_fraud_rate, suspicious_amount,
  p95_fraud_score FROM hourly ORDER BY metric_window DESC""",
        "kpi_rebuild": f"WITH {SCORES} {kpis('day', 'scores')}",
        "current_scores": f"""WITH {SCORES}
SELECT transaction_id, CASE WHEN label = 1 THEN 'second' ELSE model_version END AS model_version,
  CASE WHEN label = 1 THEN fraud_score / 2 ELSE fraud_score END AS fraud_score,
  CASE WHEN label = 1 THEN scored_at + INTERVAL 1 DAY ELSE scored_at END AS scored_at FROM scores""",
        "score_histogram": f"""WITH {SCORES}
SELECT CAST(CASE WHEN fraud_score < 0 THEN 0 WHEN fraud_score >= 1 THEN 11
  ELSE floor(fraud_score * 10) + 1 END AS BIGINT) AS score_bucket, count(*) AS transactions
FROM scores GROUP BY 1""",
        "alerts": f"WITH {SCORES} SELECT * FROM scores WHERE prediction = 1",
        "top_risk_hours": f"""WITH {SCORES}, hourly AS (
  SELECT date_trunc('hour', event_timestamp)::TIMESTAMP AS metric_window,
         CAST(sum(prediction) AS BIGINT) AS predicted_frauds,
         CAST(sum(prediction) AS DOUBLE) / count(*) AS rate FROM scores GROUP BY 1)
SELECT metric_window, predicted_frauds, round(rate, 9) AS predicted_fraud_rate FROM hourly
ORDER BY rate DESC, metric_window LIMIT 10""",
        "layer_counts": """
SELECT 'bronze' AS layer, count(*) AS records FROM events UNION ALL
SELECT 'silver_clean', count(*) FROM events UNION ALL SELECT 'gold_scores', count(*) FROM events""",
        "json_payload": f"""WITH {SCORES}
SELECT transaction_id AS key, "Amount", label, fraud_score, prediction, model_version FROM scores""",
        "json_alerts": f"WITH {SCORES} SELECT transaction_id FROM scores WHERE prediction = 1",
        "null_counts": " UNION ALL ".join(
            part for name, columns in TABLE_COLUMNS.items() for part in profile(name, name, columns)
        ),
        "duplicate_ids": """
SELECT count(*) AS duplicate_ids FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)""",
        "conflicting_labels": f"""WITH {LINES}
SELECT count(*) AS conflicting_ids FROM (
  SELECT transaction_id FROM lines GROUP BY 1 HAVING count(DISTINCT label) > 1)""",
        "class_distribution": """
SELECT 'class_distribution' AS metric_name, coalesce(CAST(quality AS VARCHAR), 'None') AS metric_dimension,
  CAST(count(*) AS DOUBLE) AS metric_value
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""",
        "quality_report": quality(),
        "quality_listing": SCORE_QUALITY,
        "keep_first": f"""WITH {LINES}
SELECT transaction_id, l_orderkey, l_linenumber, label, raw_event_id FROM lines
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY raw_event_id) = 1""",
        "derived_ids": """
SELECT o_orderkey, o_orderstatus <> 'F' AS derived,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR)
            ELSE sha256(concat_ws('|', CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR), '')) END AS transaction_id
FROM orders""",
        "id_rules_agree": "SELECT count(*) AS compared, 0::BIGINT AS differing FROM orders",
        "exact_cut_points": f"""WITH {TXN}
SELECT 0.6::DOUBLE AS share, quantile_disc("Time", 0.6) AS value FROM txn UNION ALL
SELECT 0.8::DOUBLE, quantile_disc("Time", 0.8) FROM txn""",
        "temporal_split_counts": f"""WITH {TXN}, {split('txn', '"Time"', '"Class"')}""",
        "split_order_lines": f"WITH {LINES}, {split('lines', 'l_quantity', 'label')}",
        "time_window": f"""WITH {TXN}
SELECT event_id, "Time" FROM txn WHERE "Time" >= 864000 AND "Time" < 1728000""",
        "confusion_at_threshold": f"""WITH {SCORES}
SELECT {THRESHOLD}::DOUBLE AS threshold, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
  count(*) FILTER (prediction = 1 AND label = 0) AS fp, count(*) FILTER (prediction = 0 AND label = 0) AS tn,
  count(*) FILTER (prediction = 0 AND label = 1) AS fn FROM scores""",
        "threshold_sweep": f"""WITH {SCORES}, {matrices('scores')}
SELECT position, round(threshold, 9) AS threshold, {MATRIX}, {r9(*RATES)} FROM metrics""",
        "threshold_sweep_runs": f"""WITH {RUN_SCORES}, {matrices('run_scores', RUN_COLUMNS)}
SELECT {RUN_COLUMNS}, position, round(threshold, 9) AS threshold, {MATRIX}, {r9(*RATES)} FROM metrics""",
        "threshold_sweep_order_lines": f"""WITH {LINES}, {matrices('lines')}
SELECT position, round(threshold, 9) AS threshold, {MATRIX}, {r9(*RATES)} FROM metrics""",
        "choose_threshold_floor": choice("precision >= 0.2175"),
        "choose_threshold_fallback": choice("precision >= 0.7"),
        "choose_threshold_best_f1": choice("false"),
        "roc_auc_exact": f"WITH {SCORES}, {areas('scores')} SELECT round(roc_auc, 9) AS roc_auc FROM areas",
        "pr_auc_exact": f"WITH {SCORES}, {areas('scores')} SELECT round(auc_pr, 9) AS auc_pr FROM areas",
        "auc_runs": f"""WITH {RUN_SCORES}, {areas('run_scores', RUN_COLUMNS)}
SELECT {RUN_COLUMNS}, {r9('roc_auc', 'auc_pr')} FROM areas""",
        "auc_order_lines": f"WITH {LINES}, {areas('lines')} SELECT {r9('roc_auc', 'auc_pr')} FROM areas",
        "run_summary": f"""WITH {DETERMINISTIC_RUNS}, long AS (
  SELECT candidate_id, unnest(['precision', 'recall', 'f1', 'auc_pr', 'roc_auc', 'threshold']) AS metric_name,
         unnest([precision, recall, f1_score, auc_pr, roc_auc, threshold]) AS v FROM done)
SELECT candidate_id, metric_name, round(avg(v), 9) AS mean_value,
  round(coalesce(stddev_samp(v), 0), 9) AS sample_stdev, CAST(count(*) AS INTEGER) AS runs
FROM long GROUP BY candidate_id, metric_name""",
        "champion_candidate": f"""WITH {DETERMINISTIC_RUNS}, {CHAMPION}
SELECT candidate_id, {r9('mean_auc_pr', 'mean_f1')}, candidate_position FROM best""",
        "selected_runs": f"""WITH {DETERMINISTIC_RUNS}, {CHAMPION}
SELECT candidate_id, run_id, candidate_id = (SELECT candidate_id FROM best) AS selected_candidate FROM done""",
        "median_of_thresholds": f"""WITH {DETERMINISTIC_RUNS}
SELECT round(median(threshold), 9) AS threshold FROM done""",
        "confusion_at_own": f"""WITH {RUN_SCORES},
before AS (SELECT * FROM run_scores WHERE event_timestamp < TIMESTAMP '2024-01-25'),
{matrices('before', RUN_COLUMNS)}, {chosen('precision >= 0.7')},
own AS (
  SELECT {RUN_COLUMNS}, c.threshold,
         count(*) FILTER (r.fraud_score >= c.threshold AND r.label = 1) AS tp,
         count(*) FILTER (r.fraud_score >= c.threshold AND r.label = 0) AS fp,
         count(*) FILTER (r.fraud_score < c.threshold AND r.label = 0) AS tn,
         count(*) FILTER (r.fraud_score < c.threshold AND r.label = 1) AS fn
  FROM run_scores r JOIN chosen c USING ({RUN_COLUMNS})
  WHERE r.event_timestamp >= TIMESTAMP '2024-01-25' GROUP BY {RUN_COLUMNS}, c.threshold),
own_pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM own)
SELECT {RUN_COLUMNS}, round(threshold, 9) AS threshold, {MATRIX}, round(p, 9) AS precision,
  round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 9) AS f1_score
FROM own_pr""",
        "rates_per_hour": f"""WITH {SCORES}, counted AS (
  SELECT date_trunc('hour', event_timestamp)::TIMESTAMP AS metric_window,
         count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction = 1 AND label = 0) AS fp,
         count(*) FILTER (prediction = 0 AND label = 1) AS fn FROM scores GROUP BY 1),
rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM counted)
SELECT metric_window, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END, 9) AS f1_score FROM rated""",
        "model_metrics_listing": f"""WITH {MODEL_METRICS}
SELECT model_version, round(threshold, 9) AS threshold, {r9(*RATES)}, {MATRIX}, {r9('auc_pr', 'roc_auc')},
  created_at FROM model_metrics""",
        "model_metrics_long": f"""WITH {MODEL_METRICS}
SELECT model_version, round(threshold, 9) AS threshold, created_at,
  unnest(['precision', 'recall', 'f1_score', 'auc_pr', 'roc_auc']) AS metric_name,
  unnest([{', '.join(f'round({n}, 9)' for n in (*RATES, 'auc_pr', 'roc_auc'))}]) AS metric_value
FROM model_metrics""",
        "newest_score": f"""WITH {SCORES}
SELECT event_timestamp, transaction_id, "Amount" FROM scores
ORDER BY event_timestamp DESC, transaction_id DESC LIMIT 1""",
        "csv_scan": f"""WITH {TXN} SELECT event_id, "Time", user_id, k, "Amount", "Class" AS label FROM txn""",
        "csv_export": f"WITH {SCORES} {kpis('hour', 'scores')}",
        "replay_slices": f"""WITH {TXN}, numbered AS (
  SELECT event_id, row_number() OVER (ORDER BY "Time", event_id) - 1 AS row_index FROM txn)
SELECT (row_index - 100) // 250 AS replay_batch, count(*) AS batch_rows, min(row_index) AS first_row,
  CAST(sum(event_id) AS BIGINT) AS event_ids FROM numbered WHERE row_index >= 100 GROUP BY 1""",
        "stream_replay": f"""WITH {TXN}
SELECT transaction_id, event_time, "Time", user_id, k, "Amount", "Class",
  row_number() OVER (ORDER BY "Time", event_id) - 1 AS kafka_offset, 'events.parquet' AS source_file FROM txn""",
        "stream_bronze": f"""WITH {TXN}
SELECT transaction_id, event_time, "Time", user_id, k, "Amount", "Class", 'transactions.raw' AS kafka_topic,
  part AS kafka_partition, off AS kafka_offset, 'events.parquet' AS source_file, {RAW_ID} AS raw_event_id
FROM txn""",
        "stream_rejects": f"""WITH {TXN}
SELECT 'transactions.raw' AS kafka_topic, part AS kafka_partition, off AS kafka_offset,
  substr('{{"Amount":' || CAST("Amount" AS VARCHAR) || ',"Class":', 1, 20) AS value
FROM txn WHERE off % 5 = 0""",
        "experiment_row_balance": f"""WITH {TXN}, {EXPERIMENT_BLOCKS}
SELECT split_name, runs, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS outside,
  train_rows, validation_rows, test_rows
FROM sizes, (VALUES ('validation', 4::BIGINT), ('test', 2::BIGINT)) AS v(split_name, runs)""",
        "stream_score": """
SELECT scoring_run, count(*) AS scored_rows, count(DISTINCT event_id) AS scored_ids,
  CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS alerts_missing, count(*) AS sent,
  CAST(0 AS BIGINT) AS warnings_missing
FROM events, (VALUES ('batch'), ('stream')) AS v(scoring_run) GROUP BY scoring_run""",
        "batch_equals_stream": "SELECT CAST(count(*) AS BIGINT) AS differing_rows FROM events WHERE event_id IS NULL",
    }
    return {name: sql.strip() for name, sql in sqls.items()}


EXPERIMENT_BLOCKS = """
cuts AS (SELECT quantile_disc("Time", 0.6) AS c1, quantile_disc("Time", 0.8) AS c2 FROM txn),
sizes AS (
  SELECT count(*) FILTER ("Time" < c1) AS train_rows,
         count(*) FILTER ("Time" >= c1 AND "Time" < c2) AS validation_rows,
         count(*) FILTER ("Time" >= c2) AS test_rows FROM txn, cuts)"""
