"""Streams against the batch job on the same rows, restarts, late rows and the alert life cycle."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from driftwatch.catalog import FEATURES
from driftwatch.detectors import bundle as bundles
from driftwatch.operators import alerting, labels
from driftwatch.operators.rolling import features
from driftwatch.operators.scaling import Scaler
from driftwatch.plans import views
from driftwatch.storage import new_path, stage
from driftwatch.streaming import alerts, scoring, windows
from tests.conftest import SF

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, parts, start):
    """Append the parts one by one and run the stream to its end after each."""
    path = new_path(spark, "test-stream")
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        start(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


def test_stream_scores_equal_the_replay(spark):
    ticks = stage(views.clean_ticks(spark, SF), "test-ticks")
    rows = stage(labels.label_readings(features(labels.chronological_split(ticks)), views.truth(spark, SF),
                                       ["copy_no"]), "test-rows")
    trained = bundles.fit_bundle(rows, trees=20, components=4)
    cuts = [0, 7, 400, 420, 10**9]
    parts = [ticks.where(f"event_id >= {a} AND event_id < {b}") for a, b in zip(cuts, cuts[1:])]
    out = feed(spark, parts, lambda s, o, c: scoring.start_scoring(s, o, c, trained))
    columns = ["event_id", *bundles.SCORE_COLUMNS, "ensemble_score_trend", "consecutive_anomalous_ticks"]
    got = spark.read.parquet(f"{out}/scored").select(*columns).orderBy("event_id").toPandas()
    want = bundles.replay(ticks, trained).select(*columns).orderBy("event_id").toPandas()
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)


def test_late_rows_are_put_aside(spark):
    ticks = views.clean_ticks(spark, SF)
    parts = [ticks.where("event_id >= 500"), ticks.where("event_id < 500")]
    out = feed(spark, parts, lambda s, o, c: scoring.start_scoring(s, o, c, bundles.Bundle()))
    assert spark.read.parquet(f"{out}/late").count() == ticks.where("event_id < 500").count()
    assert spark.read.parquet(f"{out}/scored").count() == ticks.where("event_id >= 500").count()


def test_batches_that_overlap_in_time_equal_the_replay(spark):
    ticks = stage(views.clean_ticks(spark, SF), "test-ticks")
    low, high = ticks.agg(F.min("timestamp"), F.max("timestamp")).first()
    unit = (high - low).total_seconds() / 4
    shift = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000
    number = F.floor((F.unix_micros("timestamp") - F.unix_micros(F.lit(low))) / 1e6 / unit + shift)
    numbered = stage(ticks.withColumn("_no", F.least(number, F.lit(4))), "test-numbered")
    parts = [numbered.where(f"_no = {n}").drop("_no") for n in range(5)]
    assert parts[1].agg(F.min("timestamp")).first()[0] < parts[0].agg(F.max("timestamp")).first()[0]
    only_z = bundles.Bundle(scaler=Scaler(tuple(FEATURES), (0.0,) * len(FEATURES), (1.0,) * len(FEATURES)), zscore_threshold=1.5)
    path = new_path(spark, "test-overlap")
    step = scoring.score_step(path, only_z, delay=f"{int(2 * unit) + 1} seconds")
    for n, part in enumerate(parts):
        step(part, n)
    columns = ["event_id", *FEATURES, "zscore_value", "ensemble_score", "ensemble_score_trend", "consecutive_anomalous_ticks"]
    got = scoring.latest_scores(spark, path).select(*columns).orderBy("event_id").collect()
    want = bundles.replay(ticks, only_z).select(*columns).orderBy("event_id").collect()
    assert got == want and max(r["consecutive_anomalous_ticks"] for r in got) > 1
    assert spark.read.parquet(f"{path}/late").count() == 0


def test_a_repeated_batch_changes_nothing(spark):
    ticks = stage(views.clean_ticks(spark, SF), "test-ticks")
    path = new_path(spark, "test-repeat")
    step = scoring.score_step(path, bundles.Bundle())
    for batch_id, low, high in ((0, 0, 300), (1, 300, 600), (1, 300, 600), (2, 600, 10**9)):
        step(ticks.where(f"event_id >= {low} AND event_id < {high}"), batch_id)
    columns = ["event_id", "cpu_usage_z_score", "cpu_usage_rolling_avg"]
    got = spark.read.parquet(f"{path}/scored").select(*columns).orderBy("event_id").collect()
    assert got == features(ticks).select(*columns).orderBy("event_id").collect()


CANDIDATE = "fingerprint string, timestamp timestamp, host string, ensemble_score double, severity string"


def at(seconds):
    return AT + timedelta(seconds=seconds)


def run_alerts(spark, batches, gap=120.0, delay="10 seconds"):
    parts = [spark.createDataFrame(b, CANDIDATE) for b in batches]
    out = feed(spark, parts, lambda s, o, c: windows.start_append(alerts.alert_changes(s, gap, delay), o, c))
    return spark.read.parquet(out)


def test_alert_opens_merges_resolves_and_reopens(spark):
    batches = [
        [("a", at(0), "h1", 0.6, "WARNING")],
        [("a", at(120), "h2", 1.0, "CRITICAL"), ("a", at(60), "h1", 0.6, "INFO")],
        [("b", at(131), "h", 0.6, "INFO")],
        [("a", at(240.000001), "h3", 0.7, "INFO")],  # just beyond the gap: a new alert
        [("b", at(5000), "h", 0.6, "INFO")],  # moves the watermark on, which resolves what is old
    ]
    log = run_alerts(spark, batches)
    rows = alerting.latest_snapshot(log).orderBy("fingerprint", "created_at").collect()
    shown = [(r["fingerprint"], r["status"], r["occurrence_count"], r["severity"], r["host"]) for r in rows]
    assert shown == [
        ("a", "RESOLVED", 3, "CRITICAL", "h2"), ("a", "RESOLVED", 1, "INFO", "h3"),
        ("b", "RESOLVED", 1, "INFO", "h"), ("b", "ACTIVE", 1, "INFO", "h"),
    ]
    first = rows[0]
    assert first["resolved_at"] - first["last_seen_at"] == timedelta(seconds=120)


def test_a_reading_between_two_alerts_joins_them(spark):
    batches = [[("a", at(0), "h1", 0.6, "WARNING"), ("a", at(200), "h2", 0.7, "INFO")],
               [("a", at(100), "h3", 0.8, "CRITICAL")], [("b", at(5000), "h", 0.6, "INFO")]]
    log = run_alerts(spark, batches, delay="10 minutes")
    rows = alerting.latest_snapshot(log).where("fingerprint = 'a'").collect()
    assert [(r["status"], r["occurrence_count"], r["severity"], r["host"], r["created_at"], r["last_seen_at"]) for r in rows] == [
        ("RESOLVED", 3, "CRITICAL", "h2", at(0).replace(tzinfo=None), at(200).replace(tzinfo=None))]
    assert log.where("status = 'MERGED'").count() == 1


def test_summaries_hold_back_open_windows_and_drop_late_rows(spark):
    ticks = views.clean_ticks(spark, SF)
    low = ticks.agg(F.min("timestamp")).first()[0]
    parts = [ticks, ticks.where(F.col("timestamp") == F.lit(low))]
    out = feed(spark, parts, lambda s, o, c: windows.start_append(windows.summary_stream(s, "1 day"), o, c))
    got = spark.read.parquet(out).groupBy("window_start").agg(F.sum("sample_count").alias("n")).collect()
    want = {r["d"]: r["n"] * 7 for r in ticks.groupBy(F.date_trunc("day", "timestamp").alias("d")).agg(
        F.count("*").alias("n")).collect()}
    assert {r["window_start"]: r["n"] for r in got} == {d: n for d, n in want.items() if d != max(want)}


def rows_of(readings):
    return pd.DataFrame({
        "micros": [t * 1_000_000 for t, _ in readings],
        "severity": [s for _, s in readings], "host": [str(t) for t, _ in readings],
        "ensemble_score": [float(t) for t, _ in readings],
    })


@given(st.lists(st.tuples(st.integers(0, 2000), st.sampled_from(["INFO", "WARNING", "CRITICAL"])), min_size=1,
                max_size=40, unique_by=lambda r: r[0]), st.integers(1, 5), st.integers(0, 100))
def test_merging_parts_equals_one_pass(readings, size, seed):
    gap = 120_000_000
    whole = alerts.intervals(rows_of(readings), gap)
    random.Random(seed).shuffle(readings)
    pieces = []
    for i in range(0, len(readings), size):
        pieces = alerts.merged(pieces + alerts.intervals(rows_of(readings[i:i + size]), gap), gap)
    assert pieces == whole
    times = sorted(t for t, _ in readings)
    assert len(whole) == 1 + sum(b - a > 120 for a, b in zip(times, times[1:]))


def test_unknown_intake_mode_is_refused():
    from driftwatch.streaming.ingest import take_in
    with pytest.raises(ValueError):
        take_in("x", "ignore")


def test_rows_for_the_next_batch_are_limited_before_the_shuffle(spark, monkeypatch):
    from driftwatch.detectors.bundle import Bundle
    from driftwatch.plans import views
    from driftwatch.storage import new_path
    from driftwatch.streaming import scoring
    from tests.conftest import SF
    kept = []
    monkeypatch.setattr(scoring, "stage", lambda df, name, stage=scoring.stage: kept.append(df) or stage(df, name))
    scoring.score_step(new_path(spark, "limited"), Bundle())(views.clean_ticks(spark, SF), 0)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    counts = {r["service_name"]: r["count"] for r in kept[0].where("not _open").groupBy("service_name").count().collect()}
    assert len(counts) == 8 and set(counts.values()) == {34}
