"""The keyed store, and alerts from payloads against the batch job."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F, types as T

from driftwatch.catalog import FEATURES
from driftwatch.detectors import bundle as bundles
from driftwatch.detectors.bundle import Bundle
from driftwatch.detectors.sequence import GivenComponents
from driftwatch.escalation import classifier, explain
from driftwatch.operators import alerting
from driftwatch.operators.scaling import Scaler
from driftwatch.plans import streams, views
from driftwatch.sources.keyed import KeyedStore, upsert
from driftwatch.storage import new_path, stage
from driftwatch.streaming import live, scoring
from tests.conftest import SF

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = T.StructType([T.StructField("k", T.StringType()), T.StructField("version", T.LongType()), T.StructField("v", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def contents(spark, store):
    return sorted(map(tuple, store.read(spark, ROWS).collect()))


def test_upsert_of_repeated_and_failed_batches(spark, monkeypatch):
    store = KeyedStore(new_path(spark, "test-keyed"), ("k",), 8)
    assert contents(spark, store) == [] and store.batch(spark) is None
    upsert(store, frame(spark, [(f"k{i}", 1, "a") for i in range(20)]), "version", 0)
    upsert(store, frame(spark, [("k1", 2, "b"), ("new", 1, "b")]), "version", 1)
    after = [("k1", 2, "b"), ("new", 1, "b")] + [(f"k{i}", 1, "a") for i in range(20) if i != 1]
    assert contents(spark, store) == sorted(after)
    upsert(store, frame(spark, [("k1", 2, "b"), ("new", 1, "b")]), "version", 1)  # repeated
    upsert(store, frame(spark, [("k1", 1, "old")]), "version", 2)  # an older version changes nothing
    assert contents(spark, store) == sorted(after)

    write = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: 1 / 0)
    changes = stage(store.read(spark, ROWS).where("k = 'k2'").withColumns({"version": F.lit(9).cast("long"), "v": F.lit("c")}), "test-changes")
    with pytest.raises(ZeroDivisionError):  # the data are written, the manifest is not
        upsert(store, changes, "version", 3)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, _w=write.__func__, **b: _w(self, *a, **b))
    assert contents(spark, store) == sorted(after) and store.batch(spark) == 2
    upsert(store, changes, "version", 3)
    assert ("k2", 9, "c") in contents(spark, store) and len(contents(spark, store)) == 21


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    store = KeyedStore(new_path(spark, "test-keyed"), ("k",), 32)
    upsert(store, frame(spark, [(f"k{i}", 1, "a") for i in range(2000)]), "version", 0)
    upsert(store, frame(spark, [("k77", 2, "b")]), "version", 1)
    written = spark.read.option("basePath", f"{store.path}/data").parquet(f"{store.path}/data/_version=1")
    assert written.select("_bucket").distinct().count() == 1 and written.count() < 200
    assert len(contents(spark, store)) == 2000


def test_scoring_one_of_many_services_rewrites_its_bucket_only(spark):
    one = views.clean_ticks(spark, SF).limit(1).drop("service_name").withColumn("service_name", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(2000)), lambda i: F.concat(F.lit("s"), i.cast("string")))))
    path = new_path(spark, "test-many")
    step = scoring.score_step(path, Bundle())
    step(one, 0)
    step(one.where("service_name = 's7'").withColumn("timestamp", F.expr("timestamp + interval 1 second")), 1)
    store = KeyedStore(f"{path}/state", ("service_name",))
    state = store.read(spark, one.schema)
    assert state.count() == 2001 and state.where("service_name = 's7'").count() == 2
    assert spark.read.parquet(f"{path}/state/data/_version=1").select("_bucket").distinct().count() == 1
    assert spark.read.parquet(f"{path}/scored/batch_id=1").count() == 1


def candidates(spark, readings):
    rows = [(f"multivariate:{s}", s, AT + timedelta(seconds=t), h, e) for s, t, h, e in readings]
    base = spark.createDataFrame(rows, "fingerprint string, service_name string, timestamp timestamp, host string, severity string")
    none = {"ensemble_score": "double", "detected_by": "struct<votes:int>", "triggering_metrics": "array<struct<metric:string>>",
            **alerting.ESCALATION_COLUMNS}
    return live.as_intervals(base.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}), live.ORDER)


def test_intervals_merge_like_one_pass(spark):
    rng = random.Random(1)
    readings = [("busy", rng.randrange(40_000), f"h{i}", rng.choice(["INFO", "WARNING", "CRITICAL"])) for i in range(900)]
    readings += [(f"s{i % 3}", 120 * i, "h", "INFO") for i in range(9)] + [("busy", 5, "twice", "INFO")] * 2
    whole = live.merged(candidates(spark, readings), 120_000_000, live.ORDER)
    got = sorted((r.service_name, (r.started_at.replace(tzinfo=timezone.utc) - AT).total_seconds(), r.occurrence_count, r.latest.host)
                 for r in whole.collect())
    want = []
    for service in {s for s, *_ in readings}:
        run = []
        for t, h in [*sorted((t, h) for s, t, h, _ in readings if s == service), (10**9, "")]:
            if run and t - run[-1][0] > 120:
                want.append((service, float(run[0][0]), len(run), run[-1][1]))
                run = []
            run.append((t, h))
    assert got == sorted(want)
    halves = [live.merged(candidates(spark, part), 120_000_000, live.ORDER) for part in (readings[::2], readings[1::2])]
    again = live.merged(halves[0].union(halves[1]), 120_000_000, live.ORDER)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_a_busy_fingerprint_is_reduced_before_its_rows_meet(spark):
    rows = candidates(spark, [("s1", 1, "h", "INFO")]).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50_000))))
    rows = rows.withColumn("started_at", F.col("started_at") + F.make_dt_interval(secs=F.col("i") / 1000)).drop("i").repartition(8)
    found = live.merged(rows.withColumn("last_seen_at", F.col("started_at")), 10_000_000, live.ORDER)
    assert [r.occurrence_count for r in found.collect()] == [50_000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_min" in plan  # cells are made where the rows are


def shown(df):
    rows = df.select("fingerprint", "created_at", "last_seen_at", "occurrence_count", "severity", "host", "anomaly_score", "detected_by.votes",
                     F.transform("triggering_metrics", lambda m: m["metric"]).alias("metrics"), "escalation_probability", "explanation_text",
                     "status", "resolved_at")
    return sorted(map(str, rows.collect()))


def test_live_alerts_equal_the_batch_job(spark):
    """Batches that overlap in time, come in any order within the delay, and of which one is repeated."""
    ticks = stage(views.clean_ticks(spark, SF).drop("event_id"), "test-ticks")
    low, high = ticks.agg(F.min("timestamp"), F.max("timestamp")).first()
    unit = (high - low).total_seconds() / 3
    shift = F.pmod(F.xxhash64("timestamp"), F.lit(1000)) / 1000
    number = F.floor((F.unix_micros("timestamp") - F.unix_micros(F.lit(low))) / 1e6 / unit + shift)
    numbered = stage(ticks.withColumn("_no", F.least(number, F.lit(3))), "test-numbered")
    bundle = Bundle(scaler=Scaler(tuple(FEATURES), (0.0,) * len(FEATURES), (1.0,) * len(FEATURES)), zscore_threshold=1.2)
    leaves, gap = streams.given_escalation(), 6 * 3600.0
    path = new_path(spark, "test-live")
    step = live.live_step(path, bundle, leaves, gap, f"{int(2 * unit) + 1} seconds", "repair", buckets=4)
    for batch_id in (0, 1, 1, 2, 3):
        part = numbered.where(f"_no = {batch_id}").drop("_no")
        step(part.select("service_name", "host", "timestamp", F.struct(*(c for c in part.columns if c not in (
            "service_name", "host", "timestamp"))).alias("metrics")), batch_id)
    replayed = bundles.replay(ticks, bundle, order=live.ORDER)
    want = alerting.alerts(explain.explain_leaves(replayed, leaves), gap, high, order=live.ORDER)
    got = live.stored_alerts(spark, path, gap, high)
    assert got.columns == want.columns and want.count() > 20
    assert shown(got) == shown(want)
    state = KeyedStore(f"{path}/alerts/state", ("fingerprint",))
    assert state.batch(spark) == 3


def test_leaves_explain_like_the_model(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(4), rng.random(), rng.random() * 6, rng.random() - 0.5, rng.choice([None, rng.random()]), int(
        rng.random() < 0.4)) for _ in range(300)], "votes int, ensemble_score double, zscore_value double, iforest_score double, "
                                                   "lstm_error double, will_be_severe int")
    rows = stage(rows, "test-escalation")
    model = classifier.fit(rows, trees=5)
    columns = ["votes", "zscore_value", F.round("escalation_margin", 9), "escalation_probability", "explanation_text"]
    one, other = (sorted(map(str, df.select(*columns).collect())) for df in (
        explain.explain(rows, model), explain.explain_leaves(rows, explain.read_leaves(spark, model))))
    assert one == other


def test_given_components_are_the_residual(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 5.0]],), (None,)], "sequence array<array<double>>")
    half = 2 ** -0.5
    got = GivenComponents(((half, 0.0, half, 0.0),)).add_error(rows).select("lstm_error").collect()
    assert got[0][0] == pytest.approx((1 + 4 + 9 + 25 - (4 * half) ** 2) / 4) and got[1][0] is None


def test_a_batch_scores_the_forest_without_a_queue(spark):
    """Rows of a micro-batch pass through the forest without the sequences that their errors are computed from."""
    from driftwatch.operators.rolling import add_features
    from driftwatch.operators.series import series
    from driftwatch.plans import views
    from driftwatch.plans.streams import given_bundle
    ticks = views.clean_ticks(spark, SF).withColumn("more", F.lit("kept"))
    made = add_features(series(ticks, ["service_name"], ["timestamp", "event_id"], 34))
    s = bundles.score(made, given_bundle(), made.df.columns)
    plan = s.df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    node = bundles.score(made, given_bundle()).df._jdf.queryExecution().optimizedPlan()
    while not node.nodeName().startswith("ArrowEvalPython"):
        node = node.children().apply(0)
    fed = node.children().apply(0).output().mkString(" ")
    assert "lstm_error" in fed and "_sequence" not in fed and "_vector" not in fed
    assert {"more", *bundles.SCORE_COLUMNS} <= set(s.rows().columns) and s.rows().where("more = 'kept'").count() == ticks.count()
