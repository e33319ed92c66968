"""Detectors, bundle, escalation model and explanations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.catalog import ESCALATION_FEATURES, FEATURES, METRICS, SEQUENCE_ROWS
from driftwatch.detectors import bundle as bundles, forest
from driftwatch.detectors.bundle import Bundle
from driftwatch.escalation import classifier, explain
from driftwatch.operators import labels
from driftwatch.operators.rolling import check_feature_order, features
from driftwatch.plans import views
from driftwatch.storage import new_path, stage
from tests.conftest import SF


@pytest.fixture(scope="module")
def training(spark):
    rows = features(labels.chronological_split(views.clean_ticks(spark, SF)))
    return stage(labels.label_readings(rows, views.truth(spark, SF), ["copy_no"]), "test-training")


@pytest.fixture(scope="module")
def trained(training):
    return bundles.fit_bundle(training, trees=30, components=4)


def test_expected_path():
    assert [forest.expected_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.expected_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), 3.0) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    return spark.createDataFrame(rows + [(1000, 9.0, -9.0, 3.0)], "id long, x double, y double, constant double")


def test_forest_finds_the_outlier_and_ignores_partitioning(spark):
    rows, inputs = points(spark), [F.col("x"), F.col("y"), F.col("constant")]
    a = forest.fit(rows, inputs, ["id"], trees=40)
    b = forest.fit(rows.repartition(7), inputs, ["id"], trees=40)
    assert a.nodes.reset_index(drop=True).equals(b.nodes.reset_index(drop=True)) and a.offset == b.offset
    scored = rows.select("id", a.decision(spark, inputs).alias("s")).orderBy("s").collect()
    assert scored[0]["id"] == 1000
    assert sum(r["s"] < 0 for r in scored) == pytest.approx(40, abs=2)
    assert a.nodes.groupby("tree").size().max() <= 2 * 256 - 1
    missing = rows.limit(1).withColumn("x", F.lit(None).cast("double"))
    assert missing.select(a.decision(spark, inputs).alias("s")).first()["s"] is None


def test_sequence_errors_are_small_for_what_was_learnt(spark, training, trained):
    rows = bundles.replay(views.clean_ticks(spark, SF), trained)
    per_service = rows.groupBy("service_name").agg(
        F.count("*").alias("n"), F.count("lstm_error").alias("e"), F.min("lstm_error").alias("low"))
    for r in per_service.collect():
        assert r["e"] == max(0, r["n"] - SEQUENCE_ROWS + 1) and r["low"] >= 0
    assert rows.count() == training.count()


def test_stored_bundle_scores_the_same(spark, trained):
    path = new_path(spark, "test-bundle")
    trained.save(spark, path)
    loaded = Bundle.load(spark, path)
    ticks = views.clean_ticks(spark, SF)
    columns = ["event_id", *bundles.SCORE_COLUMNS, "consecutive_anomalous_ticks"]
    a = bundles.replay(ticks, trained).select(*columns).orderBy("event_id").collect()
    b = bundles.replay(ticks, loaded).select(*columns).orderBy("event_id").collect()
    assert a == b


def test_missing_parts_only_disable_their_detector(spark):
    nothing = Bundle.load(spark, new_path(spark, "nowhere"))
    assert nothing == Bundle()
    rows = bundles.replay(views.clean_ticks(spark, SF), nothing)
    row = rows.agg(F.count("*").alias("n"), F.max("votes").alias("v"), F.max("available").alias("a"),
                   F.max("ensemble_score").alias("s")).first()
    assert (row["n"], row["v"], row["a"], row["s"]) == (1000, 0, 0, 0.0)


def test_chunks_do_not_change_the_replay(spark, trained):
    from driftwatch.operators.series import measure
    ticks = views.clean_ticks(spark, SF)
    cut = measure(ticks, ["service_name"], "timestamp", 40)
    assert cut.cells is not None
    columns = ["event_id", "votes", "ensemble_score", "ensemble_score_trend", "consecutive_anomalous_ticks"]
    a = bundles.replay(ticks, trained).select(*columns).orderBy("event_id").collect()
    b = bundles.replay(ticks, trained, widths=cut).select(*columns).orderBy("event_id").collect()
    assert a == b


def test_healthy_steady_reading_is_normal(spark):
    """Trained on steady noise, a service at its usual values is not an anomaly."""
    usual = dict(zip(METRICS, (40.0, 55.0, 70.0, 100.0, 0.002, 20.0, 47.0)))
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        bad = i % 50 in (48, 49)
        rows.append((i, 1_700_000_000 + i, "s", bad, *(float(v * (3 if bad else 1 + 0.03 * rng.normal()))
                                                      for v in usual.values())))
    ticks = spark.createDataFrame(rows, "event_id long, at long, service_name string, is_anomaly boolean, "
                                  + ", ".join(f"{m} double" for m in METRICS)).withColumn(
        "timestamp", F.timestamp_seconds("at"))
    table = stage(features(labels.chronological_split(ticks)), "test-steady")
    trained = bundles.fit_bundle(table, trees=50, components=4)
    calm = spark.range(25).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_800_000_000).alias("timestamp"),
        F.lit("t").alias("service_name"), *(F.lit(v).alias(m) for m, v in usual.items()))
    last = bundles.replay(calm, trained).orderBy(F.desc("event_id")).first()
    assert last["available"] == 3 and not last["ensemble_is_anomaly"]


def test_feature_order_is_checked():
    check_feature_order(FEATURES, list(FEATURES))
    with pytest.raises(ValueError):
        check_feature_order(FEATURES, list(reversed(FEATURES)))


@pytest.fixture(scope="module")
def escalation(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        votes, z, f = int(rng.integers(0, 4)), float(rng.gamma(2)), float(rng.normal())
        error = None if i % 7 == 0 else float(rng.gamma(1))
        severe = int(z + 2 * (error or 0) - f + rng.normal() > 3)
        rows.append((i, votes, votes / 3, z, f, error, severe))
    df = spark.createDataFrame(rows, "id long, votes int, ensemble_score double, zscore_value double, "
                                     "iforest_score double, lstm_error double, will_be_severe int")
    return df, classifier.fit(df, trees=8)


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_contributions_sum_to_the_margin(spark, escalation, depth):
    df, model = escalation
    if depth != 3:
        model = classifier.fit(df, trees=4, depth=depth)
    base = explain.read_leaves(spark, model).base
    told = explain.explain(df, model)
    total = sum((F.col(f"contributions.{f}") for f in ESCALATION_FEATURES), F.lit(base))
    row = told.agg(F.max(F.abs(total - F.col("escalation_margin"))).alias("gap"),
                   F.max(F.abs(F.round(1 / (1 + F.exp(-F.col("escalation_margin"))), 4)
                               - F.col("escalation_probability"))).alias("p")).first()
    assert row["gap"] < 1e-9 and row["p"] < 1e-9


@pytest.mark.parametrize("depth", [3, 6])
def test_contributions_are_shapley_values(spark, escalation, depth):
    """Against the definition: the average effect of a feature over all orders in which features become known."""
    df, model = escalation
    if depth != 3:
        model = classifier.fit(df, trees=2, depth=depth)
    leaves = explain.read_leaves(spark, model)
    assert leaves.feature.shape[1] == 3 if depth == 3 else leaves.feature.shape[1] > 3
    x = np.array([[float(v) for v in r] for r in df.select(*classifier.inputs()).limit(3).collect()])

    def expectation(row, known):
        total = 0.0
        for v, fs, low, high, share in zip(leaves.value, leaves.feature, leaves.low, leaves.high, leaves.share):
            part = v
            for f, a, b, s in zip(fs, low, high, share):
                part *= (a < row[f] <= b) if f in known else s
            total += part
        return total

    got = explain.shapley(x, leaves)
    n = x.shape[1]
    for i, row in enumerate(x):
        for f in range(n):
            want = sum(
                math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                * (expectation(row, {*s, f}) - expectation(row, set(s)))
                for k in range(n) for s in itertools.combinations([g for g in range(n) if g != f], k))
            assert got[i, f] == pytest.approx(want, abs=1e-9)


def test_importances_and_classes(spark, escalation):
    df, model = escalation
    rows = classifier.importances(model, spark).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    with pytest.raises(ValueError):
        classifier.fit(df.where("will_be_severe = 1"))


def sentence(spark, p, **given):
    df = spark.createDataFrame([(p, 2, 0.667, 3.157, -0.013, 0.124, given)],
                               "p double, votes int, ensemble_score double, zscore_value double, iforest_score double, "
                               "lstm_error double, contributions struct<" + ",".join(
                                   f"{f}:double" for f in ESCALATION_FEATURES) + ">")
    df = df.withColumn("top", explain.top_contributions())
    row = df.select(explain.sentence(F.col("p"), F.col("top")).alias("t"),
                    explain.contributing_features(F.col("top")).alias("c")).first()
    return row["t"], [tuple(e) for e in row["c"]]


def test_explanation_sentence(spark):
    text, top = sentence(spark, 0.799, votes=-0.004, ensemble_score=9.0, zscore_value=0.444, iforest_score=0.267,
                         lstm_error=0.672)
    assert text == (
        "This incident looks likely to become severe (80% confidence), mainly because the recent sequence of readings "
        "didn't match any normal pattern the system has learned, and the readings were far outside their normal "
        "statistical range. A smaller factor: the overall combination of metrics looked highly unusual to the "
        "pattern-detection model.")
    assert top == [("lstm_error", 0.124, 0.672), ("zscore_value", 3.157, 0.444), ("iforest_score", -0.013, 0.267)]
    text, _ = sentence(spark, 0.2, votes=-2.0, ensemble_score=0.0, zscore_value=-0.1, iforest_score=0.0, lstm_error=0.0)
    assert text.startswith("This incident looks unlikely to become severe (20% confidence), mainly because only a few")


def test_trees_draw_from_the_whole_table(spark):
    """Two trees of a table of 20,000 rows share only what chance gives, and many trees together see most rows."""
    from driftwatch.detectors import forest
    rows = spark.range(20_000).selectExpr("id", "rand(1) AS x")
    nodes, size = forest.fit_nodes(rows, [F.col("x")], ["id"], trees=200)
    roots = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.count_if(F.col("left") == F.col("node")).alias("leaves")).collect()
    assert size == 256 and len(roots) == 200
    assert all(r["n"] == 2 * r["leaves"] - 1 for r in roots)
    assert nodes.where("node = 0").select("threshold").distinct().count() > 190


@pytest.mark.parametrize("n", [300, 3_000, 60_000])
def test_rows_are_drawn_alike_at_every_size(spark, n):
    """Every tree draws each row with the same chance, independently: the numbers of trees per row are binomial."""
    trees, sample = 40, 64
    p = min(1.0, 2.0 * sample / n)
    chances = forest.chances(trees, p)
    assert all(a <= b + 1e-12 for a, b in zip(chances, chances[1:]))
    for k in (0, 1, 5):
        want = sum(math.comb(trees, j) * p**j * (1 - p) ** (trees - j) for j in range(k + 1))
        assert chances[k] == pytest.approx(want, abs=1e-12)
    drawn = forest.draw(spark.range(n).withColumn("x", F.col("id").cast("double")), [F.col("x")], ["id"], trees, p, 1)
    per_row = [r["count"] for r in drawn.groupBy("x0").count().collect()]
    per_tree = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(per_tree) == trees and drawn.distinct().count() == sum(per_row)
    assert sum(per_row) == pytest.approx(trees * n * p, rel=0.1)
    assert max(abs(c - n * p) for c in per_tree) <= 6 * math.sqrt(n * p)
    assert len(per_row) == pytest.approx(n * (1 - (1 - p) ** trees), rel=0.1)


def test_the_smallest_tables_give_all_rows_to_all_trees(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "id long, x double")
    nodes, size = forest.fit_nodes(rows, [F.col("x")], ["id"], trees=5)
    assert size == 3 and nodes.where("node = 0 and threshold between 1 and 2").count() == 5


def test_decisions_beside_the_rows_equal_the_column(spark):
    rows = points(spark).withColumns({"x": F.when(F.col("id") != 7, F.col("x")), "at": F.timestamp_seconds("id"), "more": F.array("id", F.lit(None))})
    inputs = [(F.col(c) - 1.0) / 2.0 for c in ("x", "y", "constant")]
    grown = forest.fit(rows.where("x is not null"), inputs, ["id"], trees=20)
    want = rows.withColumn("s", grown.decision(spark, inputs)).orderBy("id")
    got = grown.add_decision(rows, inputs, "s").orderBy("id")
    assert got.columns == want.columns and got.collect() == want.collect()
    assert got.where("s is null").count() == 1
    some = grown.add_decision(rows, inputs, "s", ["more", "id"]).orderBy("id")
    assert some.columns == ["more", "id", "s"] and some.collect() == want.select("more", "id", "s").collect()


def test_rows_do_not_wait_for_the_forest_with_their_sequences(spark):
    """A scalar Python function would queue each row with the 20 vectors that its error is computed from, on disk for a large table."""
    from driftwatch.plans.streams import given_bundle
    rows = bundles.replay(views.clean_ticks(spark, SF), given_bundle(), keep=[])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_the_sequence_model_is_that_of_all_normal_windows(spark):
    """Mean and components from one pass over the stretches equal those of the windows themselves, over chunks and stretches."""
    from driftwatch.detectors.sequence import SequenceModel
    from driftwatch.operators.rolling import sequences, stretches
    from driftwatch.operators.series import series
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(2, 2)) * 2
    rows = [(i, f"s{i % 2}", i % 7 != 0, [float(v) for v in rng.normal(size=2) @ mixed + 0.5]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k string, good boolean, vector array<double>").withColumn("ts", F.timestamp_seconds("id"))
    stored = stage(stretches(series(df, ["k"], ["ts", "id"], 4, 200), "vector", ["id", "good"], 5), "test-stretches")
    windows = sequences(stored, length=5).where("good and sequence is not null")
    x = np.array([np.ravel(r["sequence"]) for r in windows.collect()])
    model = SequenceModel.fit(stored, lambda row: row["good"], 3, 5)
    assert np.allclose(model.center.mean.toArray(), x.mean(axis=0), rtol=1e-12)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    assert np.allclose(np.abs((model.components.pc.toArray() * want).sum(axis=0)), 1, atol=1e-9)
    centered = x - x.mean(axis=0)
    error = ((centered**2).sum(axis=1) - ((centered @ want)**2).sum(axis=1)) / x.shape[1]
    got = [r["lstm_error"] for r in model.add_error(windows).collect()]
    assert np.allclose(sorted(got), sorted(error), atol=1e-9)
    with pytest.raises(ValueError):
        SequenceModel.fit(stored, lambda row: row["id"] < 0, 3, 5)


def test_fitting_scores_each_row_once(spark):
    rows, inputs = points(spark).withColumn("bad", F.col("id") % 9 == 0), [F.col("x"), F.col("y")]
    one = forest.fit(rows.where("not bad"), inputs, ["id"], trees=20)
    both, scores = forest.fit_scored(rows, ~F.col("bad"), ["bad", "id"], inputs, ["id"], trees=20)
    assert both.offset == one.offset and both.nodes.reset_index(drop=True).equals(one.nodes.reset_index(drop=True))
    want = rows.select(one.decision(spark, inputs).alias("v"), "bad", "id").orderBy("id").collect()
    assert scores.orderBy("id").collect() == want


def test_forest_follows_its_nodes(spark):
    """Against one row at a time, over more rows than are scored at once."""
    rng = np.random.default_rng(8)
    table = [(i, *(float(v) for v in rng.normal(size=2))) for i in range(5_000)]
    rows = spark.createDataFrame(table, "id long, x double, y double").coalesce(1)
    grown = forest.fit(rows, [F.col("x"), F.col("y")], ["id"], trees=3)
    trees = [{n.node: n for n in part.itertuples()} for _, part in grown.nodes.groupby("tree")]
    got = {r["id"]: r["s"] for r in rows.select("id", grown.score_samples(spark, [F.col("x"), F.col("y")]).alias("s")).collect()}
    for i in [0, 1, 2047, 2048, 4999]:
        paths = []
        for nodes in trees:
            at = nodes[0]
            while at.left != at.node:
                at = nodes[at.left if table[i][1 + at.feature] <= at.threshold else at.right]
            paths.append(at.path)
        assert got[i] == pytest.approx(-2 ** (-sum(paths) / 3 / forest.expected_path(256)), abs=1e-12)
