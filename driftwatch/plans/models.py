"""Queries: trained detectors, replay, escalation and its explanations."""

import math

import numpy as np
from pyspark.sql import functions as F

from driftwatch.catalog import ESCALATION_FEATURES, FEATURES, METRICS, REASONS
from driftwatch.detectors import bundle as bundles, forest
from driftwatch.detectors.bundle import Bundle, scaled
from driftwatch.escalation import classifier, explain
from driftwatch.operators import alerting, evaluation, labels
from driftwatch.operators.rolling import SEQUENCE_LOOKBACK, add_sequence, feature_vector, features
from driftwatch.operators.scaling import Scaler
from driftwatch.operators.series import Widths, series
from driftwatch.operators.training import read_training_set, write_training_set
from driftwatch.plans import views
from driftwatch.plans.ingest import ntz
from driftwatch.plans.labelling import LINE
from driftwatch.plans.registry import query
from driftwatch.plans.views import sql
from driftwatch.sources import tables
from driftwatch.storage import new_path, stage

_shared: dict[tuple, object] = {}


def shared(make):
    """Derive something once per session and folder, as several queries start from it."""
    def get(spark, sf):
        key = (make.__name__, spark.sparkContext.applicationId, sf)
        if key not in _shared:
            _shared[key] = make(spark, sf)
        return _shared[key]
    return get


@shared
def widths(spark, sf):
    return views.widths(spark, sf)


@shared
def training_rows(spark, sf):
    # Labels meet the ticks before these get their features, which are three times as wide.
    rows = labels.label_readings(labels.chronological_split(views.clean_ticks(spark, sf)), views.truth(spark, sf), LINE)
    return stage(features(rows, scale=views.SCALE, widths=widths(spark, sf)), "training")


@shared
def trained(spark, sf):
    return bundles.fit_bundle(training_rows(spark, sf), widths=widths(spark, sf))


def replayed(spark, sf, bundle=None):
    return bundles.replay(views.clean_ticks(spark, sf), bundle or trained(spark, sf), widths=widths(spark, sf), keep=[])


def _at(df):
    return df.select(ntz("timestamp"), *(c for c in df.columns if c != "timestamp"))


@query("M4 M5")
def isolation_forest_scores(spark, sf):
    bundle = trained(spark, sf)
    return training_rows(spark, sf).select(
        "event_id", "is_anomaly", bundle.forest.decision(spark, scaled(bundle.scaler)).alias("iforest_score"))


@query("M4")
def isolation_forest_nodes(spark, sf):
    rows = views.feature_rows(spark, sf)
    nodes, _ = forest.fit_nodes(rows, [F.col(f) for f in FEATURES], ["event_id"])
    return nodes.groupBy("tree").agg(F.count("*").alias("nodes"), F.max("path").alias("longest_path"))


@query("M6 S12")
def sequence_errors(spark, sf):
    bundle = trained(spark, sf)
    rows = training_rows(spark, sf)
    s = series(rows, ["service_name"], ["timestamp", "event_id"], SEQUENCE_LOOKBACK, widths=widths(spark, sf))
    windows = add_sequence(s.with_columns({"vector": bundle.scaler.vector()}), "vector").rows()
    return bundle.sequence.add_error(windows).select("event_id", "lstm_error")


@query("M8 S13 S15 F13 T6")
def replayed_scores(spark, sf):
    path = new_path(spark, "bundle")
    trained(spark, sf).save(spark, path)
    rows = replayed(spark, sf, Bundle.load(spark, path))
    return rows.select("event_id", *bundles.SCORE_COLUMNS, "ensemble_score_trend", "consecutive_anomalous_ticks")


@query("S15 M7", sql("""select event_id, zscore_value, false as iforest_flag, zscore_value > 3.0 as ensemble_is_anomaly,
    (zscore_value > 3.0)::int as votes from (select event_id, round(zscore_value, 6) as zscore_value from scored0)""",
                     "scored0"))
def scores_without_models(spark, sf):
    """Only the z-score detector is there: it decides alone."""
    rows = stage(views.feature_rows(spark, sf).select("event_id", *FEATURES), "features")  # read by the scaler and the score
    s = series(rows, [], ["event_id"], 0, widths=Widths((), 1, None))  # no window looks back any more
    scored = bundles.score(s, Bundle(scaler=Scaler.fit(rows), zscore_threshold=3.0)).rows()
    return scored.select("event_id", F.round("zscore_value", 6).alias("zscore_value"), "iforest_flag",
                         "ensemble_is_anomaly", "votes")


@query("M8 M15 A15")
def trained_detection_quality(spark, sf):
    rows = replayed(spark, sf)
    judged = labels.label_readings(rows, views.truth(spark, sf), LINE)
    return evaluation.confusion(judged, "is_anomaly", ["zscore_flag", "iforest_flag", "lstm_flag",
                                                       "ensemble_is_anomaly"])


@shared
def escalation_rows(spark, sf):
    """Early anomalous readings with stand-in scores and the split of their episode."""
    # Labels meet the ticks before these get their features and scores, which are several times as wide.
    ticks = labels.label_readings(views.clean_ticks(spark, sf), views.truth(spark, sf), LINE)
    rows = stage(labels.early_readings(views.scored(spark, sf, widths(spark, sf), ticks)), "early")
    return stage(rows.join(labels.episode_split(rows).select("episode_id", "split"), "episode_id"), "escalation")


@shared
def escalation_model(spark, sf):
    return classifier.fit(escalation_rows(spark, sf).where("split = 'train'"))


def _meta(rows):
    return rows.where("split = 'test'").select("episode_id", "category", "anomaly_type", "severity")


@query("S14", sql("""
    , early as (select l.* from labelled l where is_anomaly and progress <= 0.5 and episode_id is not null),
    e as (select episode_id, row_number() over (order by min("timestamp")) > (count(*) over () * 4) // 5 as test
          from early group by episode_id)
    select episode_id, category, anomaly_type, severity from early join e using (episode_id) where test""", "labelled"))
def escalation_meta(spark, sf):
    """What the CSV beside the escalation matrix holds, read back."""
    path = new_path(spark, "escalation-meta")
    tables.write_csv(_meta(escalation_rows(spark, sf)), path)
    return spark.read.option("header", True).csv(path).select("episode_id", "category", "anomaly_type", "severity")


_FIXED = Scaler(tuple(FEATURES), (50.0,) * len(FEATURES), (10.0,) * len(FEATURES))
_SCALED = " + ".join(f"({f} - 50.0::double) / 10.0::double" for f in FEATURES)
_LAST_20 = f"over ({views.W} rows between 19 preceding and current row)"


@query("S12 S13 F13 M1 W6", sql(f"""
    , r as (select *, {_SCALED} as total, case when row_number() over (order by "timestamp", event_id) <= (count(*) over () * 80) // 100
                then 'train' else 'test' end as split from labelled),
    s as (select *, count(*) {_LAST_20} = 20 as complete, sum(total) {_LAST_20} as together from r)
    select split, count(*) as "rows", sum(is_anomaly::int)::bigint as anomalies, count_if(complete)::bigint as sequences,
        round(sum(total), 3) as total, round(sum(case when complete then together end), 2) as sequence_total,
        28::bigint as width, 20::bigint as length from s group by split""", "labelled"))
def training_set(spark, sf):
    """Features, sequences, labels and splits of all readings, stored and read back; another order of features is refused."""
    path = new_path(spark, "training-set")
    write_training_set(training_rows(spark, sf), path, _FIXED, widths=widths(spark, sf))
    try:
        read_training_set(spark, path, FEATURES[::-1])
        raise AssertionError("a training set with other features was not refused")
    except ValueError:
        rows = read_training_set(spark, path, scaler=_FIXED)

    def added(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"), F.sum("label").alias("anomalies"), F.count("sequence").alias("sequences"),
        F.round(F.sum(added(F.col("features"))), 3).alias("total"),
        F.round(F.sum(added(F.flatten("sequence"))), 2).alias("sequence_total"),
        F.max(F.size("features")).cast("long").alias("width"), F.max(F.size("sequence")).cast("long").alias("length"))


@query("S12 S14", sql(f"""
    , early as (select l.episode_id, l."timestamp", (l.severity = 'severe')::int as y from labelled l
                where is_anomaly and progress <= 0.5 and episode_id is not null),
    e as (select episode_id, row_number() over (order by min("timestamp")) <= (count(*) over () * 4) // 5 as train
          from early group by episode_id),
    r as (select case when train then 'train' else 'test' end as split, y from early join e using (episode_id))
    select split, count(*) as "rows", sum(y)::bigint as severe,
           (select count(*) from r where split = 'test') as meta_rows from r group by split""", "labelled"))
def escalation_files(spark, sf):
    rows = escalation_rows(spark, sf)
    path = new_path(spark, "escalation")
    vector = feature_vector(ESCALATION_FEATURES)
    rows.select("split", vector.alias("features"), F.col("will_be_severe").alias("label")).write.partitionBy(
        "split").parquet(f"{path}/matrix")
    tables.write_csv(_meta(rows), f"{path}/meta")
    stored = spark.read.parquet(f"{path}/matrix").groupBy("split").agg(
        F.count("*").alias("rows"), F.sum("label").alias("severe"))
    meta = spark.read.option("header", True).csv(f"{path}/meta").agg(F.count("*").alias("meta_rows"))
    return stored.select("*", meta.scalar().alias("meta_rows"))


@query("M14 M15")
def escalation_predictions(spark, sf):
    rows = escalation_rows(spark, sf)
    told = classifier.predict(escalation_model(spark, sf), rows.where("split = 'test'"))
    return told.select("event_id", "will_be_severe", "escalation_probability", "predicted_severe")


@query("M15 M16 A15")
def escalation_quality(spark, sf):
    rows = escalation_rows(spark, sf)
    told = classifier.predict(escalation_model(spark, sf), rows.where("split = 'test'")).withColumn("always", F.lit(True))
    return evaluation.confusion(told, "will_be_severe", ["predicted_severe", "always"])


@query("A23")
def escalation_importances(spark, sf):
    return classifier.importances(escalation_model(spark, sf), spark)


@query("M17")
def escalation_contributions(spark, sf):
    rows = escalation_rows(spark, sf)
    model = escalation_model(spark, sf)
    told = explain.explain(rows, model)
    return told.select("event_id", "escalation_margin", "contributions.*")


@query("M18 M19 M11")
def explained_alerts(spark, sf):
    rows = escalation_rows(spark, sf)
    told = explain.explain(rows.where("split = 'test'"), escalation_model(spark, sf))
    return alerting.alert_rows(told).select("event_id", "severity", "escalation_probability", "explanation_text")


_GIVEN = {
    "votes": "votes - 2.5", "ensemble_score": "0.0", "zscore_value": "zscore_value - 3.0",
    "iforest_score": "-iforest_score", "lstm_error": "coalesce(lstm_error, 0.1) - 0.4",
}
_P = "least(greatest(cpu_usage / 100.0, 0.0), 1.0)"
_SHOWN = [f for f in ESCALATION_FEATURES if f != "ensemble_score"]


def _text(i):
    cases = " ".join(
        f"when '{f}' then case when top[{i}].c > 0 then '{up}' else '{down}' end"
        for f, (up, down) in ((f, tuple(t.replace("'", "''") for t in REASONS[f])) for f in _SHOWN))
    return f"case top[{i}].feature {cases} end"


@query("M18 M19 O3 X8 X15", sql(f"""
    select event_id, top[1].feature as first_feature, round(top[1].c, 6) as first_contribution,
        concat('This incident looks ', case when p >= 0.5 then 'likely' else 'unlikely' end, ' to become severe (',
            cast(cast(round(p * 100, 0) as int) as varchar), '% confidence), mainly because ', {_text(1)}, ', and ',
            {_text(2)}, '. A smaller factor: ', {_text(3)}, '.') as explanation_text
    from (select event_id, floor({_P.replace('cpu_usage', 'cpu_usage::double')} * 100) / 100 as p, list_sort([{', '.join(
        f"{{'size': -abs({_GIVEN[f]}), 'place': {i}, 'feature': '{f}', 'c': {_GIVEN[f]}}}"
        for i, f in enumerate(ESCALATION_FEATURES) if f in _SHOWN)}]) as top from scored)""", "scored"))
def explanation_sentences(spark, sf):
    rows = views.scored(spark, sf).withColumn("contributions", F.struct(*(
        F.expr(e).cast("double").alias(f) for f, e in _GIVEN.items()))).withColumn("p", F.expr(f"floor({_P} * 100) / 100"))
    rows = rows.withColumn("top", explain.top_contributions())
    return rows.select("event_id", F.col("top")[0]["feature"].alias("first_feature"),
                       F.round(F.col("top")[0]["contribution"], 6).alias("first_contribution"),
                       explain.sentence(F.col("p"), F.col("top")).alias("explanation_text"))


# A given tree of depth 6, one metric at each level: (cut, share of rows above it, log-odds above it); below the last cut, _BELOW.
_LEVELS = [(62.0, 0.31, 0.83), (47.0, 0.62, -0.57), (430.0, 0.73, 0.29), (31.0, 0.54, -0.41), (0.13, 0.83, 0.67), (19.0, 0.71, -0.19)]
_BELOW = 0.47


def given_tree():
    above, below = (lambda i: (_LEVELS[i][0], np.inf, _LEVELS[i][1])), (lambda i: (-np.inf, _LEVELS[i][0], 1 - _LEVELS[i][1]))
    depth = len(_LEVELS)
    paths = [[*map(below, range(i)), above(i)] for i in range(depth)] + [[*map(below, range(depth))]]
    low, high, share = np.moveaxis(np.array([p + [(-np.inf, np.inf, 1.0)] * (depth - len(p)) for p in paths]), 2, 0)
    feature = np.tile(np.arange(depth), (len(paths), 1))
    return explain.Leaves(np.array([v for _, _, v in _LEVELS] + [_BELOW]), feature, low, high, share)


def _expected(level=0):
    """Mean log-odds when the metrics in the bits of `known` are known."""
    if level == len(_LEVELS):
        return f"{_BELOW}::double"
    cut, share, value = _LEVELS[level]
    above = f"(case when known & {1 << level} > 0 then ({METRICS[level]} > {cut})::int else {share}::double end)"
    return f"({above} * {value}::double + (1 - {above}) * {_expected(level + 1)})"


_SET_WEIGHTS = [f"{math.factorial(k) * math.factorial(len(_LEVELS) - 1 - k)} / {math.factorial(len(_LEVELS))}::double" for k in range(len(_LEVELS))]


def _effect(level):
    return (f"case when known & {1 << level} > 0 then weights[bit_count(known)] else -weights[bit_count(known) + 1] end")


@query("M17", sql(f"""
    , sets as (select range::int as known, [{', '.join(_SET_WEIGHTS)}] as weights from range({1 << len(_LEVELS)})),
    means as (select event_id, known, weights, {_expected()} as mean from clean, sets)
    select event_id, {', '.join(f'round(sum(mean * {_effect(i)}), 6) as {METRICS[i]}' for i in range(len(_LEVELS)))}
    from means group by event_id""", "clean"))
def contributions_of_a_deep_tree(spark, sf):
    """Shapley contributions of six metrics to a given tree of depth 6; the SQL goes through all their sets."""
    rows = views.clean_ticks(spark, sf)
    names = METRICS[:len(_LEVELS)]
    told = rows.withColumn("contributions", explain.contributions(spark, given_tree(), names))
    return told.select("event_id", *(F.round(f"contributions.{m}", 6).alias(m) for m in names))
