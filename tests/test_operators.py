"""Worked examples and edge cases of the stateless operators."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.catalog import METRICS, SCENARIOS, scenario_catalogue
from driftwatch.functions import columns
from driftwatch.operators import alerting, cleaning, evaluation, labels, neighbours, rollup
from driftwatch.operators.quantiles import order_statistics, percentiles
from driftwatch.operators.scaling import Scaler

AT = datetime(2026, 8, 17, 10, tzinfo=timezone.utc)
TICK = "service_name string, host string, timestamp timestamp, " + ", ".join(f"{m} double" for m in METRICS)


def dirty(spark):
    return spark.createDataFrame([("payment", "h", AT, 150.0, None, 65.0, 80.0, -0.1, 15.0, 48.0)], TICK)


def one(df):
    return df.first().asDict()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_repair_and_reject(spark):
    row = one(cleaning.repair(dirty(spark), flags=True))
    assert [row[m] for m in METRICS] == [100.0, 0.0, 65.0, 80.0, 0.0, 15.0, 48.0]
    assert row["repaired_fields"] == 3 and row["cpu_usage_repaired"] and not row["disk_usage_repaired"]
    good, bad = cleaning.validate(dirty(spark))
    assert good.isEmpty() and len(one(bad)["reasons"]) == 3
    assert cleaning.to_narrow(cleaning.repair(dirty(spark))).count() == 7


def test_unknown_metric_is_only_filled(spark):
    rows = spark.createDataFrame([("x", None), ("x", -5.0), ("cpu_usage", 400.0)], "metric_name string, value double")
    assert sorted(r["value"] for r in cleaning.repair_narrow(rows).collect()) == [-5.0, 0.0, 100.0]


def test_pivot_keeps_first_and_tolerates_missing_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "cpu_usage", None, 1), (1, "cpu_usage", 7.0, 2), (1, "cpu_usage", 8.0, 3), (1, "disk_usage", 1.0, 4)],
        "t int, metric_name string, value double, seq int")
    wide = cleaning.to_wide(rows, ["t"], "seq")
    assert one(wide)["cpu_usage"] == 7.0 and one(wide)["memory_usage"] is None
    assert cleaning.complete_ticks(wide).isEmpty()


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError):
        cleaning.require_rows(dirty(spark).where("false"))


@pytest.mark.parametrize("micros, second", [(0, 0), (500_000, 0), (500_001, 1), (1_500_000, 2), (2_500_000, 2),
                                            (-500_000, 0), (-1_500_000, -2)])
def test_nearest_second(spark, micros, second):
    ts = F.timestamp_micros(F.lit(micros))
    assert value(spark, F.unix_micros(columns.nearest_second(ts))) == second * 1_000_000
    columns.register_sql(spark)
    assert value(spark, F.unix_micros(F.expr(f"nearest_second(timestamp_micros({micros}))"))) == second * 1_000_000


def test_time_of_day(spark):
    def factor(text):
        return value(spark, columns.load_factor(F.lit(text).cast("timestamp")))
    assert factor("2024-01-01 14:00:00") == pytest.approx(1.0)
    assert factor("2024-01-01 02:00:00") == pytest.approx(0.3)
    assert value(spark, columns.off_hours(F.lit("2024-01-01 02:00:00").cast("timestamp")))


def test_intensity(spark):
    got = [value(spark, columns.severity_of_intensity(F.lit(x))) for x in (0.61, 0.62, 0.85)]
    assert got == ["mild", "moderate", "severe"]


def test_catalogue(spark):
    assert scenario_catalogue(spark).count() == 23 and len(SCENARIOS) == 12


@pytest.mark.parametrize("values, flags, want", [
    ((1.0, 1.0, 1.0), (True, True, False), (2, 3, 0.6667, True)),
    ((1.0, 1.0, None), (True, False, False), (1, 2, 0.5, False)),
    ((1.0, None, None), (True, False, False), (1, 1, 1.0, True)),
    ((None, None, None), (False, False, False), (0, 0, 0.0, False)),
])
def test_vote(spark, values, flags, want):
    made = columns.vote([F.lit(f) for f in flags], [F.lit(v).cast("double") for v in values])
    assert tuple(value(spark, c) for c in made) == want


@pytest.mark.parametrize("p, votes, available, want", [
    (0.50, 2, 3, "CRITICAL"), (0.20, 2, 3, "WARNING"), (0.19, 3, 3, "INFO"),
    (None, 3, 3, "CRITICAL"), (None, 2, 3, "WARNING"), (None, 0, 0, "WARNING"),
])
def test_alert_severity(spark, p, votes, available, want):
    column = columns.alert_severity(F.lit(p).cast("double"), F.lit(votes), F.lit(available))
    assert value(spark, column) == want


@pytest.mark.parametrize("stored, fresh, want", [("CRITICAL", "WARNING", "CRITICAL"), ("INFO", "WARNING", "WARNING")])
def test_merge_never_lowers_severity(spark, stored, fresh, want):
    old = spark.createDataFrame([("f", 5, stored, AT, "ACTIVE")],
                                "fingerprint string, occurrence_count int, severity string, created_at timestamp, "
                                "status string")
    new = spark.createDataFrame([("f", fresh, AT + timedelta(seconds=5))],
                                "fingerprint string, severity string, timestamp timestamp")
    row = one(alerting.merge_alert(old, new))
    assert (row["occurrence_count"], row["severity"]) == (6, want)
    assert one(alerting.merge_alert(old.where("false"), new))["occurrence_count"] == 1


def test_merge_counts_all_candidates_and_keeps_other_alerts(spark):
    old = spark.createDataFrame(
        [("f", 5, "INFO", AT, AT + timedelta(seconds=60), "ACTIVE", "h1"), ("g", 2, "CRITICAL", AT, AT, "ACTIVE", "h2"),
         ("r", 9, "INFO", AT, AT, "RESOLVED", "h3")],
        "fingerprint string, occurrence_count int, severity string, created_at timestamp, last_seen_at timestamp, "
        "status string, host string")
    new = spark.createDataFrame(
        [("f", "WARNING", AT + timedelta(seconds=5), "n1"), ("f", "INFO", AT - timedelta(seconds=5), "n2"),
         ("n", "INFO", AT, "n3"), ("n", "INFO", AT + timedelta(seconds=1), "n4")],
        "fingerprint string, severity string, timestamp timestamp, host string")
    got = {r["fingerprint"]: r for r in alerting.merge_alert(old, new).collect()}
    assert sorted(got) == ["f", "g", "n"]
    f, g, n = got["f"], got["g"], got["n"]
    assert (f["occurrence_count"], f["severity"], f["host"]) == (7, "WARNING", "h1")
    plain = AT.replace(tzinfo=None)
    assert (f["created_at"], f["last_seen_at"]) == (plain - timedelta(seconds=5), plain + timedelta(seconds=60))
    assert (g["occurrence_count"], g["host"], n["occurrence_count"], n["host"]) == (2, "h2", 2, "n4")


def test_triggering_metrics_break_ties_by_payload_order(spark):
    cells = {m: 1.0 for m in METRICS} | {f"{m}_z_score": 0.5 for m in METRICS}
    cells |= {"request_latency_ms_z_score": -3.2, "cpu_usage_z_score": 3.9}
    row = spark.createDataFrame([cells]).select(alerting.triggering_metrics().alias("t")).first()["t"]
    assert [e["metric"] for e in row] == ["cpu_usage", "request_latency_ms", "memory_usage"]


def test_latest_snapshot(spark):
    log = spark.createDataFrame([("a", 2, "ACTIVE"), ("a", 3, "RESOLVED"), ("b", 2, "ACTIVE")],
                                "id string, version long, status string")
    assert sorted(tuple(r) for r in alerting.latest_snapshot(log).collect()) == [
        ("a", 3, "RESOLVED"), ("b", 2, "ACTIVE")]


def test_trailing_window_is_closed_at_both_ends(spark):
    rows = spark.createDataFrame(
        [("s", "m", AT - timedelta(minutes=m), float(m)) for m in (0, 5, 6)],
        "service_name string, metric_name string, timestamp timestamp, value double")
    assert one(rollup.trailing_summary(rows, AT))["sample_count"] == 2


@pytest.mark.parametrize("make", [
    lambda r: [r.gauss(0, 1) for _ in range(500)],
    lambda r: [r.choice([1.0, 2.0, 2.0, 2.0, 1e9]) for _ in range(301)],
    lambda r: [5.0] * 20,
    lambda r: [0.1],
])
def test_percentiles_are_exact(spark, make):
    values = make(random.Random(3))
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    asked = [0, 10, 33.3, 50, 75, 99.5, 100]
    assert percentiles(df, "x", asked) == pytest.approx(list(np.percentile(values, asked)), abs=1e-9)


def test_order_statistics_of_whole_numbers(spark):
    values = [random.Random(1).randrange(10**17) for _ in range(50)] * 3
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = order_statistics(df, "x", [0, 7, 149])
    assert got == {r: sorted(values)[r] for r in (0, 7, 149)}


def test_split_orders_equal_times_by_the_tie_breaker(spark):
    rows = [(AT, i) for i in range(30)] + [(AT - timedelta(days=1), 99)]
    df = spark.createDataFrame(rows, "timestamp timestamp, event_id long").repartition(4)
    split = labels.chronological_split(df, {"train": 0.5, "test": 1.0})
    train = sorted(r["event_id"] for r in split.where("split = 'train'").collect())
    assert train == [*range(14), 99]


def test_labels_join_once_or_for_every_line(spark):
    ticks = spark.createDataFrame([("s", AT), ("s", AT + timedelta(seconds=9))], "service_name string, timestamp timestamp")
    truth = spark.createDataFrame(
        [("s", AT + timedelta(microseconds=400_000), True, "x", 1), ("s", AT, True, "first", 0)],
        "service_name string, timestamp timestamp, is_anomaly boolean, anomaly_type string, line int")
    once = labels.label_readings(ticks, truth, ["line"])
    assert sorted((r["is_anomaly"], r["anomaly_type"]) for r in once.collect()) == [(False, None), (True, "first")]
    assert labels.label_readings(ticks, truth, dedup=False).count() == 3
    assert one(labels.repeated_keys(truth))["repeated"] == 1


def test_scaler_ignores_constant_columns_and_round_trips(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = Scaler.fit(df, ["a", "b"])
    assert scaler.stds == (1.0, 1.0)
    back = scaler.inverse(scaler.transform(df))
    assert [(r["a_raw"], r["b_raw"]) for r in back.orderBy("a").collect()] == [(1.0, 5.0), (3.0, 5.0)]
    assert Scaler.from_df(scaler.to_df(spark)) == scaler


def test_sweep_equals_counting_per_threshold(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, 1.5, 2.0, rng.uniform(0, 3)]), rng.random() < 0.3) for _ in range(200)] + [(None, True)]
    df = spark.createDataFrame(rows, "x double, y boolean")
    for above in (True, False):
        got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in evaluation.threshold_sweep(
            df, "x", "y", [0.0, 1.0, 1.5, 2.0, 9.0], above).collect()}
        for t, counts in got.items():
            hit = [(x > t if above else x < t, y) for x, y in rows if x is not None]
            assert counts == (sum(h and y for h, y in hit), sum(h and not y for h, y in hit),
                              sum(y and not h for h, y in hit))
        assert len(got) == 5


def test_best_threshold_takes_the_first_of_equals(spark):
    sweep = spark.createDataFrame([(2.0, 1.0, 1.0, 0.5), (1.0, 1.0, 1.0, 0.5), (3.0, 1.0, 1.0, 0.4)],
                                  "threshold double, precision double, recall double, f1 double")
    assert one(evaluation.best_threshold(sweep))["threshold"] == 1.0


@pytest.mark.parametrize("block, pivots", [(4096, 8), (7, 5), (1, 1)])
def test_nearest_against_brute_force(spark, block, pivots):
    rng = np.random.default_rng(4)
    rows = [[float(x) for x in np.round(rng.normal(size=3), 2)] for _ in range(60)]
    rows += [rows[0]] * 40  # a third are copies of one row
    queries = [[float(x) for x in rng.normal(size=3)] for _ in range(15)] + [rows[0]] * 10
    r = spark.createDataFrame(list(enumerate(rows)), "row long, v array<double>")
    q = spark.createDataFrame(list(enumerate(queries)), "query long, v array<double>")
    got = {m["query_id"]: (m["row_id"], m["distance"]) for m in neighbours.nearest(
        q, r, "query", "row", "v", pivots, block).collect()}
    assert len(got) == len(queries)
    for i, x in enumerate(queries):
        d = np.sqrt(((np.array(rows) - x) ** 2).sum(axis=1))
        assert got[i][0] == int(d.argmin()) and got[i][1] == pytest.approx(d.min(), abs=1e-12)


def test_order_statistics_at_the_ends_of_the_number_range(spark):
    longs = [-2**63, -5, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in longs], "x long")
    assert order_statistics(df, "x", [0, 1, 2, 3]) == dict(enumerate(longs))
    doubles = [-1.7e308, 0.0, 5e-324, 1e-323, 1.7e308]
    df = spark.createDataFrame([(x,) for x in doubles], "x double")
    assert order_statistics(df, "x", [0, 1, 2, 3, 4]) == dict(enumerate(doubles))


def test_episodes_that_start_together_are_split(spark):
    from driftwatch.operators.labels import episode_split
    early = spark.createDataFrame([(f"e{i}", AT) for i in range(40)], "episode_id string, timestamp timestamp")
    got = {r["split"]: r["count"] for r in episode_split(early).groupBy("split").count().collect()}
    assert got == {"train": 32, "test": 8}


def test_history_opens_only_the_wanted_days(spark):
    from driftwatch.operators.cleaning import between
    from driftwatch.storage import new_path
    path = new_path(spark, "dated")
    days = spark.range(5).selectExpr("id", "timestamp'2024-01-01 12:00:00' + make_interval(0,0,0,cast(id as int)) AS timestamp")
    days.withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(path)
    found = between(spark.read.parquet(path), F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03 13:00:00").cast("timestamp"))
    assert sorted(r["id"] for r in found.collect()) == [1, 2]
    assert "date" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
