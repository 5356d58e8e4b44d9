"""States that add up, compaction, lookups by time, and typed layers that advance by dates."""

import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import rollup
from ledgerwatch.operators.asof import with_version_in_force
from ledgerwatch.operators.quality import quality_report
from ledgerwatch.operators.quality_state import read_states, state_report, update_states
from ledgerwatch.plans import silver as plans
from ledgerwatch.session import materialize
from ledgerwatch.sources.catalog import LayerTable, layer_tables, read_layer, replace_step, save_layer
from ledgerwatch.sources.compaction import compact_steps, read_compacted
from ledgerwatch.spec import TransactionSpec

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCORES = "event_timestamp timestamp, Amount double, prediction int, fraud_score double, model_version string"


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    odd = [None, 0.0, 1.0, -0.5, 1.5, float("nan")]
    rows = [
        (START + timedelta(minutes=rng.randrange(10_000)), 1.5, rng.randrange(2), rng.choice(odd) if i % 50 == 0 else rng.random() ** 3, rng.choice("ab"))
        for i in range(4_000)
    ]
    return rows, spark.createDataFrame(rows, SCORES)


def test_states_add_up_in_any_order(scored):
    _, df = scored
    whole = rollup.hourly_states(df)
    parts = [rollup.hourly_states(df.filter(F.pmod(F.hash("event_timestamp", "fraud_score"), F.lit(3)) == k)) for k in (2, 0, 1)]
    added = rollup.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["hour", "model_version"])

    def rows(states):
        return sorted((r.hour, r.model_version, r.total_transactions, r.predicted_frauds, r.scored, [tuple(c) for c in r.histogram]) for r in states.collect())

    assert rows(added) == rows(whole)
    twice = rollup.merged(rollup.merged(added, [F.date_trunc("day", "hour").alias("day"), "model_version"]), ["model_version"])
    once = rollup.merged(whole, ["model_version"])
    assert sorted((r[0], r.total_transactions, r.histogram) for r in twice.collect()) == sorted((r[0], r.total_transactions, r.histogram) for r in once.collect())


@pytest.mark.parametrize("level", [0.01, 0.5, 0.95, 1.0])
def test_a_quantile_lies_in_its_bin(scored, level):
    rows, df = scored
    found = rollup.with_measures(rollup.merged(rollup.hourly_states(df), ["model_version"]), level).collect()
    for r in found:
        mine = sorted((x[3] for x in rows if x[4] == r.model_version and x[3] is not None), key=lambda s: (s != s, s))
        exact = mine[math.ceil(level * len(mine)) - 1]
        low = -1e9 if r.quantile_low is None else r.quantile_low
        high = 1e9 if r.quantile_high is None else r.quantile_high
        assert low <= (2.0 if exact != exact else exact) <= high, (level, exact, r)
        if 0 <= exact <= 1:
            assert high - low == 1 / rollup.BINS
    assert sum(r.total_transactions for r in found) == len(rows)


def test_states_of_null_scores_and_of_nothing(spark, folder):
    rows = [(START, 1.0, None, None, "a")]
    states = rollup.hourly_states(spark.createDataFrame(rows, SCORES))
    (r,) = rollup.with_measures(rollup.merged(states, ["model_version"])).collect()
    assert (r.total_transactions, r.predicted_frauds, r.quantile_low, r.quantile_high, r.avg_fraud_score) == (1, 0, None, None, None)
    assert rollup.hourly_states(spark.createDataFrame([], SCORES)).count() == 0
    path = folder("states")
    for _ in range(2):
        rollup.save_states(states, path)  # replaced, not added
    assert rollup.merged(spark.read.parquet(path), ["model_version"]).first().total_transactions == 1
    rollup.add_states(states, path)
    assert rollup.merged(spark.read.parquet(path), ["model_version"]).first().total_transactions == 2


def test_versions_in_force(spark):
    rng = random.Random(4)
    versions = [(START + timedelta(minutes=rng.randrange(3_000)), f"v{i}") for i in range(40)] + [(None, "never")]
    versions += [(versions[3][0], "v9z")]
    rows = [(i, START + timedelta(minutes=rng.randrange(-100, 4_000))) for i in range(800)]
    rows += [(1000 + i, versions[i][0]) for i in range(40)] + [(2000, None)]
    got = with_version_in_force(
        spark.createDataFrame(rows, "n int, at timestamp"), spark.createDataFrame(versions, "since timestamp, name string"), "at", "since", ["name"]
    )
    for r in got.collect():
        at = None if r.at is None else r.at.replace(tzinfo=timezone.utc)
        before = [v for v in versions if v[0] is not None and at is not None and v[0] <= at]
        assert r.name == (max(before)[1] if before else None)
    assert got.count() == len(rows)
    none = with_version_in_force(spark.createDataFrame(rows, "n int, at timestamp"), spark.createDataFrame([], "since timestamp, name string"), "at", "since", ["name"])
    assert none.filter("name is null").count() == len(rows)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


STEPS = LayerTable(
    "steps",
    layer_tables(TransactionSpec())["gold.fraud_scores"].schema,
    run_columns=layer_tables(TransactionSpec())["gold.fraud_scores"].run_columns,
)


class Stopped(Exception):
    pass


def stop():
    raise Stopped


@pytest.fixture
def steps(spark, folder):
    path = f"{folder('compact')}/scores"
    expected = {}

    def write(run, batch, rows, day=0):
        data = [(f"{run}-{batch}-{i}", START + timedelta(days=day + i % 2), float(i)) for i in range(rows)]
        df = spark.createDataFrame(data, "transaction_id string, scored_at timestamp, fraud_score double")
        for f in STEPS.schema:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        replace_step(df, STEPS, {"scoring_run": run, "scoring_batch_id": batch}, path)
        expected[run, batch] = rows

    def check():
        got = defaultdict(int)
        for r in read_compacted(spark, STEPS, path).collect():
            got[r.scoring_run, r.scoring_batch_id] += 1
            assert r.transaction_id.startswith(f"{r.scoring_run}-{r.scoring_batch_id}-")
        assert dict(got) == {k: v for k, v in expected.items() if v}

    return path, write, check


def live(spark, path):
    return read_layer(spark, STEPS, path).select("scoring_run", "scoring_batch_id").distinct().count()


def test_compaction_keeps_rows_and_bounds_folders(spark, steps):
    path, write, check = steps
    for batch in range(7):
        write("a", batch, 3)
    write("b", 0, 5, day=1)
    assert compact_steps(spark, STEPS, path) == 5
    check()
    assert live(spark, path) == 3
    for batch in range(7, 10):
        write("a", batch, 2, day=1)
    assert compact_steps(spark, STEPS, path) == 3
    check()
    folders = spark.read.parquet(f"{path}-compacted/lists").collect()
    assert len(folders) == len({r.day for r in folders}) == 3 and len({r.version for r in folders}) == 1
    assert compact_steps(spark, STEPS, path) == 0


def test_a_step_repeated_after_compaction_replaces_its_rows(spark, steps):
    path, write, check = steps
    for batch in range(4):
        write("a", batch, 4)
    compact_steps(spark, STEPS, path, keep=1)
    write("a", 1, 2, day=5)  # fewer rows, on other days
    check()
    write("a", 5, 1)
    compact_steps(spark, STEPS, path, keep=0)
    check()
    write("a", 2, 0)
    check()  # a step that became empty


def test_compacted_rows_do_not_meet_by_step(spark, steps):
    path, write, check = steps
    for batch in range(3):
        write("a", batch, 4)
    compact_steps(spark, STEPS, path, keep=1)
    plan = read_compacted(spark, STEPS, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    check()


@pytest.mark.parametrize("where", ["after_write", "after_list"])
def test_compaction_that_is_stopped(spark, steps, where):
    path, write, check = steps
    for batch in range(5):
        write("a", batch, 3)
    compact_steps(spark, STEPS, path, keep=3)
    with pytest.raises(Stopped):
        compact_steps(spark, STEPS, path, keep=1, **{where: stop})
    check()
    write("a", 6, 2)
    assert compact_steps(spark, STEPS, path, keep=1) == 3
    check()
    assert live(spark, path) == 1


SPEC = TransactionSpec(features=("Time", "Amount"))


@pytest.fixture
def raw_layer(spark, folder):
    base = folder("advance")
    table = layer_tables(SPEC)["bronze.transactions_raw"]
    numbers = iter(range(10_000))

    def arrive(day, rows, label=None, lag=0):
        data = []
        for _ in range(rows):
            n = next(numbers)
            at = START + timedelta(days=day, minutes=n)
            data.append((f"t{n}", (at - timedelta(days=lag)).isoformat(), 1.0 * n, 2.0, float(n % 2 if label is None else label), at, "t", 0, n, "f", f"r{n}"))
        df = spark.createDataFrame(data, table.schema)
        save_layer(df, table, target=f"{base}/raw")
        return df

    def advance():
        raw = read_layer(spark, table, f"{base}/raw")
        return plans.advance_silver(raw, SPEC, f"{base}/clean", f"{base}/features", f"{base}/progress")

    def stored(name="clean"):
        full = {"clean": "silver.transactions_clean", "features": "silver.transactions_features"}[name]
        return read_layer(spark, layer_tables(SPEC)[full], f"{base}/{name}")

    return base, table, arrive, advance, stored


def test_only_open_dates_are_read(spark, raw_layer):
    base, table, arrive, advance, stored = raw_layer
    for day in range(4):
        arrive(day, 6)
    assert advance() == [date(2024, 1, 1) + timedelta(days=d) for d in range(4)]
    arrive(4, 3)
    raw = read_layer(spark, table, f"{base}/raw")
    found = plans.open_dates(raw, plans.read_progress(spark, f"{base}/progress"))
    assert found == [date(2024, 1, 5)]
    read = plans.dates_only(raw, "ingestion_date", found).select(F.input_file_name().alias("f")).distinct()
    files = [r.f for r in read.collect()]
    assert files and all("ingestion_date=2024-01-05" in f for f in files)
    counted = raw.groupBy("ingestion_date").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in counted
    assert advance() == found and advance() == []
    assert stored().count() == stored("features").count() == 27


def test_late_events_open_their_date_again(raw_layer):
    _, _, arrive, advance, stored = raw_layer
    for day in range(3):
        arrive(day, 4)
    advance()
    arrive(1, 2, lag=1)
    assert advance() == [date(2024, 1, 2)]
    assert stored().count() == 14 == stored().select("raw_event_id").distinct().count()


def test_only_missing_rows_are_gathered_by_date(spark, raw_layer, monkeypatch):
    base, _, arrive, advance, stored = raw_layer
    gathered = []

    def noted(df, label, *given, **named):
        out = materialize(df, label, *given, **named)
        gathered.extend([out.count()] if label == "fresh-rows" else [])
        return out

    monkeypatch.setattr(plans, "materialize", noted)
    for day in range(3):
        arrive(day, 4)
    advance()
    again = read_layer(spark, layer_tables(SPEC)["bronze.transactions_raw"], f"{base}/raw").filter("kafka_offset = 5")
    save_layer(again.localCheckpoint(), layer_tables(SPEC)["bronze.transactions_raw"], target=f"{base}/raw")  # delivered again
    arrive(1, 2, lag=1)
    advance()
    assert gathered == [12, 2]
    assert stored().count() == stored("features").count() == stored().select("raw_event_id").distinct().count() == 14
    assert all(".zstd." in f for f in stored().inputFiles())


def test_a_run_stopped_between_its_tables_completes_both(raw_layer, monkeypatch):
    _, _, arrive, advance, stored = raw_layer
    arrive(0, 4)
    advance()
    arrive(0, 3)
    with monkeypatch.context() as patch:
        patch.setattr(plans, "feature_rows", lambda *a: stop())
        with pytest.raises(Stopped):
            advance()
    assert (stored().count(), stored("features").count()) == (7, 4)
    arrive(0, 2)
    advance()
    ids = [sorted(r[0] for r in stored(name).select("raw_event_id").collect()) for name in ("clean", "features")]
    assert ids[0] == ids[1] and len(ids[0]) == len(set(ids[0])) == 9


def test_weights_are_those_of_all_rows_so_far(raw_layer):
    _, _, arrive, advance, stored = raw_layer
    arrive(0, 6, label=0)
    arrive(0, 2, label=1)
    arrive(1, 2, label=7)  # no valid label
    advance()
    assert {(r.label, r.class_weight) for r in stored().collect()} == {(0.0, 8 / 12), (1.0, 8 / 4)}
    arrive(2, 4, label=1)
    advance()
    newest = stored().filter("ingestion_timestamp >= '2024-01-03'")
    assert {(r.label, r.class_weight) for r in newest.collect()} == {(1.0, 12 / 12)}


def test_a_run_stopped_before_its_progress_adds_nothing_twice(spark, raw_layer, monkeypatch):
    _, _, arrive, advance, stored = raw_layer
    arrive(0, 4)
    arrive(1, 4)
    with monkeypatch.context() as patch:
        patch.setattr(plans, "replace_partitions", lambda *a: stop())
        with pytest.raises(Stopped):
            advance()
    assert stored().count() == 8
    arrive(1, 2)
    assert len(advance()) == 2
    assert stored().count() == stored("features").count() == 10


def test_quality_states_equal_a_report_on_the_whole(spark, folder):
    base = folder("quality")
    read = []
    for days in ((0, 1), (2,), (1, 3)):
        rows = [(None if i % 4 == 0 else float(i), f"id{i % 300}", None if i % 9 == 0 else str(i % 2), f"2024-01-0{d + 1}") for d in days for i in range(200 + 50 * d)]
        df = spark.createDataFrame(rows, "Amount double, transaction_id string, Class string, day string")
        df.withColumn("day", F.to_date("day")).write.mode("append").partitionBy("day").parquet(f"{base}/table")
        table = spark.read.parquet(f"{base}/table")
        read.append([str(d) for d in sorted(update_states(table, "t", "day", f"{base}/states", "transaction_id", "Class"))])
    assert read == [["2024-01-01", "2024-01-02"], ["2024-01-03"], ["2024-01-02", "2024-01-04"]]
    assert update_states(table, "t", "day", f"{base}/states", "transaction_id", "Class") == []
    got = {tuple(r[:4]) for r in state_report(spark, f"{base}/states", "t", "now").collect()}
    want = {tuple(r[:4]) for r in quality_report({"t": table.drop("day")}, TransactionSpec(), "now").collect()}
    apart = {r for r in got if r[1] == "distinct_transaction_id"}
    assert got - apart == {r for r in want if r[1] != "duplicate_transaction_id"}
    ((_, _, _, estimate),) = apart
    assert abs(estimate / 300 - 1) < 0.03
    assert read_states(spark, f"{base}/states", "other").count() == 0
