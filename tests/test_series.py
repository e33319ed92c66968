"""Chunked windows, streaks and sessions against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from driftwatch.catalog import FEATURES
from driftwatch.operators.rolling import add_sequence, features, narrow_features
from driftwatch.operators.series import measure, series, sessions, streak

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_rows(seed, keys=3, n=120):
    """Irregular rows with bursts, long gaps and equal timestamps; one key owns most of them."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 30, 90, 120, 121, 4000])
        key = "a" if rng.random() < 0.6 else rng.choice("bcd"[:keys])
        rows.append((key, START + timedelta(seconds=at), i, round(rng.uniform(0, 100), 2), rng.random() < 0.7))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, id long, v double, flag boolean").repartition(5)


def per_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 1), (3, 15), (4, 10_000)])
def test_previous_rows_and_sequences(spark, seed, size):
    rows = make_rows(seed)
    s = series(frame(spark, rows), ["k"], ["ts", "id"], 10, size)
    s = s.with_columns({"before": F.collect_list("id").over(s.previous(10)), "x": F.array("v")})
    s = add_sequence(s, "x", length=5)
    got = {r["id"]: (r["before"], r["sequence"]) for r in s.rows().collect()}
    assert len(got) == len(rows)
    for group in per_key(rows).values():
        for i, r in enumerate(group):
            want = [[q[3]] for q in group[i - 4:i + 1]] if i >= 4 else None
            assert got[r[2]] == ([q[2] for q in group[max(0, i - 10):i]], want)


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 1), (3, 15), (4, 10_000)])
def test_streak(spark, seed, size):
    rows = make_rows(seed)
    df = frame(spark, rows).withColumn("brought", F.when(F.col("k") == "a", 7))
    s = series(df, ["k"], ["ts", "id"], 0, size)
    got = {r["id"]: (r["plain"], r["later"]) for r in streak(
        streak(s, "flag", "plain"), "flag", "later", "brought").rows().collect()}
    for key, group in per_key(rows).items():
        plain, later = 0, 7 if key == "a" else 0
        for r in group:
            plain, later = (plain + 1, later + 1) if r[4] else (0, 0)
            assert got[r[2]] == (plain, later)


@pytest.mark.parametrize("seed, size", [(1, 4), (2, 1), (3, 15), (4, 10_000)])
def test_sessions(spark, seed, size):
    rows = make_rows(seed)
    found = sessions(series(frame(spark, rows), ["k"], ["ts", "id"], 0, size), 120, ["id"], ["v"])
    got = sorted((r["k"], r["occurrence_count"], r["id"], r["v"]) for r in found.collect())
    want = []
    for key, group in per_key(rows).items():
        part = []
        for r in group:
            if part and r[1] - part[-1][1] > timedelta(seconds=120):
                want.append((key, len(part), part[-1][2], max(q[3] for q in part)))
                part = []
            part.append(r)
        want.append((key, len(part), part[-1][2], max(q[3] for q in part)))
    assert got == sorted(want)


def test_gap_of_exactly_the_limit_merges(spark):
    def count(micros):
        rows = [("a", START, 0, 0.0, True), ("a", START + timedelta(seconds=120, microseconds=micros), 1, 0.0, True)]
        return sessions(series(frame(spark, rows), ["k"], ["ts", "id"], 0), 120, [], []).count()
    assert (count(0), count(1)) == (1, 2)


def test_only_busy_keys_are_cut(spark):
    widths = measure(frame(spark, make_rows(5)), ["k"], "ts", 50)
    assert [r["k"] for r in widths.cells.select("k").distinct().collect()] == ["a"]


def test_a_burst_does_not_shrink_the_other_chunks(spark):
    """60,000 rows ten minutes apart and a burst of 2,000 rows within 20 seconds."""
    from driftwatch.operators.series import CHUNK

    calm = spark.range(60_000).selectExpr("'s' AS k", "timestamp_seconds(id * 600) AS ts", "id")
    burst = spark.range(2_000).selectExpr("'s' AS k", "timestamp_millis(18000000000 + id * 10) AS ts", "id + 60000 AS id")
    cut = series(calm.union(burst), ["k"], ["ts", "id"], 34, 2_000).df
    chunks = cut.groupBy(CHUNK).count().collect()
    assert len(chunks) < 100 and max(r["count"] for r in chunks) < 4_200
    assert cut.count() < 1.1 * 62_000


def readings(spark, values):
    rows = [("s", "m", START + timedelta(seconds=i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "service_name string, metric_name string, timestamp timestamp, event_id long, "
                                       "value double")


def test_first_and_flat_readings(spark):
    got = [r["labels"].asDict() for r in narrow_features(readings(spark, [5] * 11)).orderBy("event_id").collect()]
    assert all(g == {"rolling_avg": 5.0, "z_score": 0.0, "rate_of_change": 0.0} for g in got)


@pytest.mark.parametrize("ddof", [0, 1])
def test_features_against_a_loop(spark, ddof):
    import statistics
    rng = random.Random(9)
    values = [round(rng.gauss(50, 10), 3) for _ in range(40)]
    got = [r["labels"] for r in narrow_features(readings(spark, values), ddof=ddof, scale=9, rows_per_chunk=7)
           .orderBy("event_id").collect()]
    deviation = statistics.stdev if ddof else statistics.pstdev
    for i, v in enumerate(values):
        before = values[max(0, i - 10):i]
        mean = statistics.mean(before) if before else v
        z = (v - mean) / deviation(before) if len(before) >= 2 else 0.0
        assert got[i]["rolling_avg"] == pytest.approx(mean, abs=1e-8)
        assert got[i]["z_score"] == pytest.approx(z, abs=1e-8)
        assert got[i]["rate_of_change"] == pytest.approx(v - before[-1] if before else 0.0, abs=1e-8)


def test_features_take_one_shuffle(spark):
    from driftwatch.plans import views
    from tests.conftest import SF
    rows = features(views.clean_ticks(spark, SF))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "Cartesian" not in plan


@pytest.mark.parametrize("rows_per_chunk,stretch", [(1000, 128), (25, 7), (25, 1)])
def test_sequences_of_stretches_equal_windows(spark, monkeypatch, rows_per_chunk, stretch):
    from driftwatch.operators import rolling
    monkeypatch.setattr(rolling, "STRETCH", stretch)
    df = frame(spark, make_rows(8, n=400)).withColumn("vector", F.array("v", F.col("id").cast("double")))
    s = series(df, ["k"], ["ts", "id"], 5, rows_per_chunk)
    want = [(r["id"], r["flag"], r["sequence"]) for r in add_sequence(s, "vector", length=6).rows().orderBy("id").collect()]
    found = rolling.sequences(rolling.stretches(s, "vector", ["id", "flag"], 6), length=6)
    assert [(r["id"], r["flag"], r["sequence"]) for r in found.orderBy("id").collect()] == want
    assert found.columns == ["id", "flag", "sequence"]
    assert rolling.sequences(rolling.stretches(series(df.where("false"), ["k"], ["ts", "id"], 5, 9), "vector", ["id"], 6)).collect() == []


def test_scores_take_one_shuffle(spark):
    from driftwatch.detectors import bundle
    from driftwatch.operators.rolling import REPLAY_LOOKBACK, add_features
    from driftwatch.plans import views
    from driftwatch.plans.streams import given_bundle
    from tests.conftest import SF
    s = series(views.clean_ticks(spark, SF), ["service_name"], ["timestamp", "event_id"], REPLAY_LOOKBACK)
    plan = bundle.score(add_features(s), given_bundle()).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "ArrowEvalPython" in plan


def test_replay_stores_only_what_is_kept(spark, monkeypatch):
    from driftwatch.detectors import bundle
    from driftwatch.plans import views
    from driftwatch.plans.streams import given_bundle
    from tests.conftest import SF
    stored = []
    monkeypatch.setattr(bundle, "stage", lambda df, name, stage=bundle.stage: stored.append(df.columns) or stage(df, name))
    ticks = views.clean_ticks(spark, SF)
    cut = measure(ticks, ["service_name"], "timestamp", 40)
    shown = ["event_id", *bundle.SCORE_COLUMNS, "ensemble_score_trend", "consecutive_anomalous_ticks"]
    whole = bundle.replay(ticks, given_bundle(), widths=cut).select(shown).orderBy("event_id").collect()
    assert bundle.replay(ticks, given_bundle(), widths=cut, keep=["host"]).select(shown).orderBy("event_id").collect() == whole
    assert len(stored) == 2 and "cpu_usage_z_score" in stored[0]
    assert sorted(stored[1]) == sorted(["service_name", "timestamp", "event_id", "host", *bundle.SCORE_COLUMNS, "_chunk", "_copy"])


@pytest.mark.parametrize("rows_per_chunk", [None, 60])
def test_training_set_stores_each_vector_about_once(spark, tmp_path, rows_per_chunk):
    """Rows with their sequences are read back whole, over chunks, stretches and splits in any order, though vectors are stored and not sequences."""
    from driftwatch.operators.scaling import Scaler
    from driftwatch.operators.training import read_training_set, write_training_set
    n = 700
    split = lambda i: None if i % 3 == 0 and i < 60 else "train" if i < 400 or 500 < i < 520 else "test"
    made = [(i, f"s{i % 2}", split(i), None if i == 9 else i % 5 == 0, float(i)) for i in range(n)]
    df = spark.createDataFrame(made, "event_id long, service_name string, split string, is_anomaly boolean, x double").select(
        "*", F.timestamp_seconds("event_id").alias("timestamp"), *((F.col("x") + k).alias(c) for k, c in enumerate(FEATURES)))
    scaler = Scaler(tuple(FEATURES), (1.0,) * len(FEATURES), (2.0,) * len(FEATURES))
    write_training_set(df, str(tmp_path), scaler, widths=measure(df, ["service_name"], "timestamp", rows_per_chunk))
    stored = spark.read.parquet(f"{tmp_path}/rows").agg(F.sum(F.size("vectors"))).first()[0]
    assert n <= stored < 2.5 * n
    got = {r["event_id"]: r for r in read_training_set(spark, str(tmp_path), scaler=scaler).collect()}
    assert len(got) == n

    def vector(i):
        return [(i + k - 1) / 2 for k in range(len(FEATURES))]
    for i, service, part, label, _ in made:
        row = got[i]
        want = [vector(j) for j in range(i - 38, i + 1, 2)] if i >= 38 else None
        assert (row["service_name"], row["split"], row["label"]) == (service, part, None if label is None else int(label))
        assert row["features"] == vector(i) and row["sequence"] == want
