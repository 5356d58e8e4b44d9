"""SQL twins of ``bindings.models``: the same trees, fitted by SQL."""

from __future__ import annotations

from bindings.oracles import GRID_VALUES, MATRIX, RAW_ID, TXN, areas, r9
from bindings.views import COARSE

FEATURES = COARSE.features
NOW = "TIMESTAMP '2024-02-01 06:00:00'"
STAMP = "2024-02-01T06:00:00+00:00"
EXPERIMENT = "exact-20240201060000"

ROWS = f"""{TXN},
coarse AS (
  SELECT event_id, transaction_id, {RAW_ID} AS raw_event_id, "Class" AS label, "Time", ts,
         CAST(hour(ts) AS DOUBLE) AS hour, CAST(dayofweek(ts) AS DOUBLE) AS weekday, k,
         floor("Amount" / 25.0::DOUBLE) AS band FROM txn)"""

PLACES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(FEATURES))


def value(feature: str, row: str = "r") -> str:
    """The column of ``row`` that the text expression names."""
    return f"CASE {feature} " + " ".join(f"WHEN '{n}' THEN {row}.{n}" for n in FEATURES) + " END"


def weighted(name: str, source: str, where: str = "TRUE") -> str:
    """Rows with balanced class weights over themselves."""
    return f"""
{name}_n AS (SELECT count(*) AS total, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1
  FROM {source} WHERE {where}),
{name} AS (SELECT s.*, CASE WHEN label = 1 THEN CAST(total AS DOUBLE) / (2 * n1) ELSE CAST(total AS DOUBLE) / (2 * n0) END AS w
  FROM {source} s, {name}_n WHERE {where})"""


def fitted(rows: str) -> str:
    """A tree of depth 2 over ``rows`` (weights ``w``): the best split of the root (node 1) and
    of both its sides (nodes 2 and 3) over every midpoint between values of the whole table."""

    def best(depth: int) -> str:
        a = f"{rows}_{depth}"
        return f"""
{a}_bins AS (
  SELECT m.node, l.pos, l.feature, l.x, count(*) AS n, coalesce(sum(w) FILTER (label = 0), 0) AS w0,
         coalesce(sum(w) FILTER (label = 1), 0) AS w1
  FROM {rows}_long l JOIN {a} m USING (event_id) GROUP BY ALL),
{a}_sums AS (
  SELECT *, sum(n) OVER up AS ln, sum(w0) OVER up AS l0, sum(w1) OVER up AS l1,
         sum(n) OVER al AS tn, sum(w0) OVER al AS t0, sum(w1) OVER al AS t1
  FROM {a}_bins WINDOW up AS (PARTITION BY node, pos ORDER BY x), al AS (PARTITION BY node, pos)),
{a}_gains AS (
  SELECT s.*, (s.x + d.nx) / 2 AS split,
         1 - (t0 * t0 + t1 * t1) / ((t0 + t1) * (t0 + t1))
         - (l0 + l1) / (t0 + t1) * (1 - (l0 * l0 + l1 * l1) / ((l0 + l1) * (l0 + l1)))
         - (t0 + t1 - l0 - l1) / (t0 + t1)
           * (1 - ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / ((t0 + t1 - l0 - l1) * (t0 + t1 - l0 - l1))) AS gain
  FROM {a}_sums s JOIN {rows}_next d USING (feature, x) WHERE ln < tn),
{a}_best AS (
  SELECT * FROM {a}_gains WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, pos, split) = 1),
{rows}_{depth + 1} AS (
  SELECT r.event_id, 2 * m.node + CASE WHEN {value('b.feature')} <= b.split THEN 0 ELSE 1 END AS node
  FROM {rows} r JOIN {a} m USING (event_id) JOIN {a}_best b USING (node))"""

    return f"""
{rows}_long AS (SELECT r.event_id, f.pos, f.feature, {value('f.feature')} AS x, label, w FROM {rows} r, (VALUES {PLACES}) AS f(pos, feature)),
{rows}_next AS (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nx FROM (SELECT DISTINCT feature, x FROM {rows}_long)),
{rows}_0 AS (SELECT event_id, 1 AS node FROM {rows}),{best(0)},{best(1)},
{rows}_arrive AS (
  SELECT node, count(*) AS rows, sum(w) AS weight, coalesce(sum(w) FILTER (label = 1), 0) / sum(w) AS share
  FROM (SELECT * FROM {rows}_0 UNION ALL SELECT * FROM {rows}_1 UNION ALL SELECT * FROM {rows}_2) JOIN {rows} USING (event_id)
  GROUP BY node),
{rows}_splits AS (
  SELECT node, feature, split, gain FROM {rows}_0_best UNION ALL SELECT node, feature, split, gain FROM {rows}_1_best),
{rows}_kept AS (
  -- A class tree joins two leaves again that predict the same class.
  SELECT s.* FROM {rows}_splits s JOIN {rows}_arrive l ON l.node = 2 * s.node JOIN {rows}_arrive r ON r.node = 2 * s.node + 1
  WHERE s.node = 1 OR (l.share > 0.5) <> (r.share > 0.5))"""


def scored(name: str, source: str, tree: str, depth: int) -> str:
    """Rows of ``source`` with the shares of the leaves they reach in ``tree``."""
    if depth == 1:
        node_f = node_b = "n1"
    else:
        node_f, node_b = "CASE WHEN k1.node IS NULL THEN n1 ELSE n2 END", "coalesce(n2, n1)"
    return f"""
{name}_1 AS (
  SELECT r.*, CASE WHEN {value('b.feature')} <= b.split THEN 2 ELSE 3 END AS n1 FROM {source} r, {tree}_splits b WHERE b.node = 1),
{name}_2 AS (
  SELECT r.*, 2 * n1 + CASE WHEN b.node IS NULL THEN NULL WHEN {value('b.feature')} <= b.split THEN 0 ELSE 1 END AS n2
  FROM {name}_1 r LEFT JOIN {tree}_splits b ON b.node = n1),
{name}_3 AS (SELECT r.*, {node_f} AS nf, {node_b} AS nb FROM {name}_2 r LEFT JOIN {tree}_kept k1 ON k1.node = n1),
{name}_4 AS (
  SELECT r.*, f.share AS rf_fraud_probability, 1 / (1 + exp(-2 * (2 * b.share - 1))) AS gbt_fraud_probability
  FROM {name}_3 r JOIN {tree}_arrive f ON f.node = nf JOIN {tree}_arrive b ON b.node = nb),
{name} AS (SELECT *, (rf_fraud_probability + gbt_fraud_probability) / 2 AS fraud_score FROM {name}_4)"""


WHOLE = f"WITH {ROWS},{weighted('whole', 'coarse')},{fitted('whole')}"

# Nodes are numbered a parent before its left and then its right side.
NODES = f"""
tops AS (SELECT 'forest' AS model, node, feature, split, gain FROM whole_kept
  UNION ALL SELECT 'boosted', node, feature, split, 2 * gain FROM whole_splits),
shown AS (
  SELECT m.model, a.*, t.feature, t.split, t.gain,
         coalesce(2 * (SELECT count(*) FROM tops x WHERE x.model = m.model AND x.node = 2), 0) AS beside
  FROM (VALUES ('forest'), ('boosted')) AS m(model) CROSS JOIN whole_arrive a
  LEFT JOIN tops t ON t.model = m.model AND t.node = a.node
  WHERE a.node = 1 OR EXISTS (SELECT 1 FROM tops p WHERE p.model = m.model AND p.node = a.node // 2)),
numbered AS (
  SELECT *, CASE node WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 + beside WHEN 4 THEN 2 WHEN 5 THEN 3
              WHEN 6 THEN 3 + beside ELSE 4 + beside END AS place FROM shown)"""


def experiment() -> str:
    """Everything an experiment reports, up to ``metrics`` and ``deployed``."""
    sides = []
    for candidate, depth in (("stump", 1), ("pair", 2)):
        sides.append(scored(f"val_{candidate}", "validation", "trained", depth))
        sides.append(scored(f"test_{candidate}", "test", "trained", depth))
        sides.append(scored(f"dep_{candidate}", "test", "final", depth))
    union = " UNION ALL ".join(
        f"SELECT '{split}' AS split_name, '{c}' AS candidate_id, {i} AS candidate_position, label, fraud_score FROM {source}_{c}"
        for split, source in (("validation", "val"), ("test", "test"), ("deployed", "dep"))
        for i, c in enumerate(("stump", "pair"))
    )
    keys = "split_name, candidate_id, candidate_position"
    return f"""WITH {ROWS},
cuts AS (SELECT quantile_disc("Time", 0.6) AS c1, quantile_disc("Time", 0.8) AS c2 FROM coarse),
placed AS (SELECT coarse.*, CASE WHEN "Time" < c1 THEN 'train' WHEN "Time" < c2 THEN 'validation' ELSE 'test' END AS block FROM coarse, cuts),
sizes AS (SELECT count(*) FILTER (block = 'train') AS train_rows, count(*) FILTER (block = 'validation') AS validation_rows,
  count(*) FILTER (block = 'test') AS test_rows FROM placed),
validation AS (SELECT * FROM placed WHERE block = 'validation'), test AS (SELECT * FROM placed WHERE block = 'test'),
{weighted('trained', 'placed', "block = 'train'")},{fitted('trained')},
{weighted('final', 'placed', "block <> 'test'")},{fitted('final')},{','.join(sides)},
all_scores AS ({union}),
sweep AS (
  SELECT {keys}, CAST(g.position AS INTEGER) AS position, g.threshold,
         count(*) FILTER (fraud_score >= g.threshold AND label = 1) AS tp,
         count(*) FILTER (fraud_score >= g.threshold AND label = 0) AS fp,
         count(*) FILTER (fraud_score < g.threshold AND label = 0) AS tn,
         count(*) FILTER (fraud_score < g.threshold AND label = 1) AS fn
  FROM all_scores, (VALUES {GRID_VALUES}) AS g(position, threshold) GROUP BY ALL),
pr AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM sweep),
rated AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1_score FROM pr),
{areas('all_scores', keys)},
every AS (SELECT * FROM rated JOIN areas USING ({keys})),
chosen AS (SELECT * FROM every WHERE split_name = 'validation'
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY f1_score DESC, recall DESC, precision DESC, position) = 1),
best AS (SELECT candidate_id, threshold FROM chosen ORDER BY auc_pr DESC, f1_score DESC, candidate_position LIMIT 1),
results AS (
  SELECT * FROM chosen
  UNION ALL SELECT e.* FROM every e JOIN best USING (candidate_id, threshold) WHERE split_name = 'test'),
metrics AS (
  SELECT '{EXPERIMENT}' AS experiment_id, r.candidate_id, CAST(v.run AS INTEGER) AS run_id, CAST(v.seed AS INTEGER) AS seed,
         split_name, threshold, precision, recall, f1_score, auc_pr, roc_auc, tp, fp, tn, fn,
         train_rows, validation_rows, test_rows, r.candidate_id = (SELECT candidate_id FROM best) AS selected_candidate,
         '{STAMP}' AS created_at
  FROM results r, sizes, (VALUES (1, 42), (2, 52)) AS v(run, seed))"""


RUN_NUMBERS = ("threshold", "precision", "recall", "f1_score", "auc_pr", "roc_auc")


def model_oracles() -> dict[str, str]:
    base = experiment()
    moved = " UNION ALL ".join(
        f"SELECT '{m}' AS moved, label, " + ", ".join(f"{'p' if f == m else 'o'}_{f} AS {f}" for f in FEATURES) + " FROM paired"
        for m in ("", *FEATURES)
    )
    pairs = ", ".join(
        f"{f} AS o_{f}, coalesce(lead({f}) OVER ring, first_value({f}) OVER ring) AS p_{f}" for f in FEATURES
    )
    score_columns = "rf_fraud_probability, gbt_fraud_probability, fraud_score"
    shares = """
parts AS (
  SELECT model, feature, sum(gain * weight) / sum(sum(gain * weight)) OVER (PARTITION BY model) AS part
  FROM numbered WHERE feature IS NOT NULL GROUP BY model, feature),
wide AS (SELECT model, feature, part FROM parts UNION ALL SELECT 'both', feature, sum(part) / 2 FROM parts GROUP BY feature)"""
    sqls = {
        "tree_nodes": f"""{WHOLE},{NODES}
SELECT CAST(place AS INTEGER) AS node, feature, round(split, 6) AS split, model,
  CAST(CASE WHEN feature IS NOT NULL THEN place + 1 END AS INTEGER) AS "left",
  CAST(CASE WHEN feature IS NOT NULL THEN CASE node WHEN 1 THEN 2 + beside ELSE place + 2 END END AS INTEGER) AS "right",
  rows, round(weight, 6) AS weight, round(gain, 6) AS gain,
  round(CASE WHEN feature IS NULL THEN CASE model WHEN 'boosted' THEN 2 * share - 1 ELSE CASE WHEN share > 0.5 THEN 1.0 ELSE 0.0 END END END, 6) AS prediction,
  round(CASE model WHEN 'forest' THEN share END, 6) AS share
FROM numbered""",
        "tree_scores": f"""{WHOLE},{scored('out', 'coarse', 'whole', 2)}
SELECT event_id, label, {r9('rf_fraud_probability', 'gbt_fraud_probability', 'fraud_score')} FROM out""",
        "tree_score_table": f"""{WHOLE},{scored('out', 'coarse', 'whole', 2)}
SELECT transaction_id, ts AS event_timestamp, round(band, 9) AS band, round(label, 9) AS label,
  {r9('rf_fraud_probability', 'gbt_fraud_probability', 'fraud_score')},
  CASE WHEN fraud_score >= 0.5 THEN 1 ELSE 0 END AS prediction, 0.5::DOUBLE AS threshold_used,
  'exact-pair' AS model_version, {NOW} AS scored_at, 7 AS scoring_batch_id, raw_event_id FROM out""",
        "feature_importance": f"""{WHOLE},{NODES},{shares}
SELECT m.model, f.feature, round(coalesce(part, 0), 6) AS importance
FROM (VALUES ('forest'), ('boosted'), ('both')) AS m(model) CROSS JOIN (VALUES {PLACES}) AS f(pos, feature)
LEFT JOIN wide USING (model, feature)""",
        "feature_permutation": f"""{WHOLE},
hashed AS (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS place,
  CAST(greatest(1, ceil(count(*) OVER () / 1000.0)) AS BIGINT) AS blocks FROM coarse),
paired AS (SELECT label, {pairs} FROM hashed WINDOW ring AS (PARTITION BY CAST('0x' || substr(place, 1, 8) AS BIGINT) % blocks ORDER BY place)),
variants AS ({moved}),{scored('out', 'variants', 'whole', 2)},{areas('out', 'moved')}
SELECT a.moved AS feature, round(b.roc_auc, 9) AS roc_auc, round(a.roc_auc, 9) AS permuted_auc,
  round(b.roc_auc - a.roc_auc, 9) AS importance
FROM areas a, areas b WHERE a.moved <> '' AND b.moved = ''""",
        "exact_experiment_metrics": f"""{base}
SELECT experiment_id, candidate_id, run_id, seed, split_name, {r9(*RUN_NUMBERS)}, {MATRIX}, train_rows, validation_rows,
  test_rows, selected_candidate, created_at FROM metrics""",
        "exact_experiment_summary": f"""{base}
SELECT candidate_id, CASE name WHEN 'f1_score' THEN 'f1' ELSE name END AS metric_name, split_name, round(avg(v), 9) AS mean_value,
  0.0::DOUBLE AS sample_stdev, CAST(count(*) AS INTEGER) AS runs, bool_and(selected_candidate) AS selected_candidate
FROM (SELECT candidate_id, split_name, selected_candidate, unnest([{', '.join(f"'{n}'" for n in RUN_NUMBERS)}]) AS name,
        unnest([{', '.join(RUN_NUMBERS)}]) AS v FROM metrics)
GROUP BY candidate_id, name, split_name""",
        "exact_test_runs": f"""{base}
SELECT run_id, seed, {r9(*RUN_NUMBERS)}, {MATRIX} FROM metrics WHERE split_name = 'test'""",
        "exact_deployed_metrics": f"""{base}
SELECT '{EXPERIMENT}-deployment' AS model_version, {r9(*RUN_NUMBERS)}, {MATRIX}, '{STAMP}' AS created_at
FROM every JOIN best USING (candidate_id) WHERE split_name = 'deployed'""".replace("round(threshold, 9)", "round(every.threshold, 9)"),
        "exact_registry": f"""{base}
SELECT '{EXPERIMENT}-deployment' AS model_version, round(threshold, 9) AS threshold, 'best_f1' AS threshold_policy,
  {NOW} AS training_timestamp, '{','.join(FEATURES)}' AS feature_columns, '42,52' AS seeds, '{EXPERIMENT}' AS experiment_id,
  candidate_id, round(CAST(total AS DOUBLE) / (2 * n0), 9) AS legit_weight, round(CAST(total AS DOUBLE) / (2 * n1), 9) AS positive_weight,
  round(c1, 9) AS validation_from, round(c2, 9) AS test_from, train_rows, validation_rows, test_rows,
  (SELECT round(avg(f1_score), 9) FROM metrics WHERE split_name = 'test') AS test_f1,
  (SELECT round(avg(roc_auc), 9) FROM metrics WHERE split_name = 'test') AS test_roc_auc
FROM best, cuts, sizes, final_n""",
    }
    return {name: sql.strip() for name, sql in sqls.items()}


