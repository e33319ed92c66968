"""Queries: data checks, scaling, thresholds, detection quality, nearest rows."""

from pyspark.sql import functions as F

from driftwatch.catalog import FEATURES, METRICS, Z_SCORES
from driftwatch.operators import evaluation, labels
from driftwatch.operators.rolling import features
from driftwatch.operators.scaling import Scaler
from driftwatch.plans import views
from driftwatch.plans.labelling import LINE, labelled
from driftwatch.plans.registry import query
from driftwatch.plans.views import SCALE, sql
from driftwatch.storage import stage

_SPLIT = """select *, case when row_number() over (order by "timestamp", event_id) <= (count(*) over () * 4) // 5
            then 'train' else 'test' end as split from labelled"""
_WORST = "greatest(" + ", ".join(f"abs({c})" for c in Z_SCORES) + ")"


def split_features(spark, sf):
    """Feature rows with their split, which is found on the raw ticks."""
    return features(labels.chronological_split(views.clean_ticks(spark, sf)), scale=views.SCALE)


def split_rows(spark, sf):
    """Labelled feature rows with their split."""
    return labels.label_readings(split_features(spark, sf), views.truth(spark, sf), LINE)


def judged(spark, sf):
    """Scored rows with their label."""
    return labels.label_readings(views.scored(spark, sf), views.truth(spark, sf), LINE)


_JUDGED = """select s.*, l.is_anomaly, l.anomaly_type, l.severity, l.episode_id
             from scored s join labelled l using (event_id)"""


@query("A8", sql(f"""select split, count(*) as "rows", sum(is_anomaly::int)::bigint as positives,
    round(avg(is_anomaly::int), 9) as rate from ({_SPLIT}) group by split""", "labelled"))
def class_balance(spark, sf):
    return evaluation.class_balance(split_rows(spark, sf)).withColumn("rate", F.round("rate", 9))


_BROKEN = " union all ".join(
    f"""select '{m}' as feature, count_if({m} is null)::bigint as nulls,
        count_if(isnan({m}))::bigint as nans, count_if(isinf({m}))::bigint as infs from ticks""" for m in METRICS)


@query("A9", sql(_BROKEN, "ticks"))
def broken_values(spark, sf):
    return evaluation.broken_values(views.ticks(spark, sf), METRICS)


@query("A10", sql(" union all ".join(
    f"select '{f}' as feature, cast(sum(cast({f} as decimal(28,6))) as double) / count({f}) as mean, "
    f"round(stddev_pop({f}), 6) as std from feats"
    for f in FEATURES), "feats"))
def column_profile(spark, sf):
    found = evaluation.column_profile(views.feature_rows(spark, sf), FEATURES, SCALE)
    return found.select("feature", "mean", F.round("std", 6).alias("std"))


@query("A11", sql("""
    with r as (select is_anomaly, min(request_latency_ms) as low, max(request_latency_ms) as high, count(*) as n
               from labelled group by is_anomaly)
    select l.is_anomaly, cast(least(floor((l.request_latency_ms - r.low) / ((r.high - r.low) / 50)), 49) as int) as bin,
           count(*) as "rows", round(count(*) / (any_value(r.n) * any_value((r.high - r.low) / 50)), 9) as density
    from labelled l join r on l.is_anomaly = r.is_anomaly group by 1, 2""".replace("with r as", ", r as", 1),
                  "labelled"))
def class_histogram(spark, sf):
    rows = stage(labelled(spark, sf).select("is_anomaly", "request_latency_ms"), "histogram")
    found = evaluation.class_histogram(rows, "request_latency_ms")
    return found.select("is_anomaly", "bin", "rows", F.round("density", 9).alias("density"))


@query("A18 X2", sql(f"""select round(min(least({', '.join(Z_SCORES)})), 6) as z_min,
    round(max(greatest({', '.join(Z_SCORES)})), 6) as z_max,
    round(avg(({' + '.join(Z_SCORES)}) / 7), 6) as z_mean, round(min({_WORST}), 6) as worst_min,
    round(max({_WORST}), 6) as worst_max, round(avg({_WORST}), 6) as worst_mean,
    round(avg(({_WORST} > 5.75)::int), 6) as share_above from feats""", "feats"))
def z_summary(spark, sf):
    row = evaluation.z_summary(views.feature_rows(spark, sf))
    return row.select(*(F.round(c, 6).alias(c) for c in row.columns))


@query("A18", sql("select round(median(z), 6) as median_z from ("
                  + " union all ".join(f"select abs({c}) as z from feats" for c in Z_SCORES) + ")", "feats"))
def z_median(spark, sf):
    rows = stage(views.feature_rows(spark, sf).select(*Z_SCORES), "z")
    return spark.createDataFrame([(evaluation.z_median(rows),)], "median_z double").select(
        F.round("median_z", 6).alias("median_z"))


_ARGMAX = "case " + " ".join(f"when abs({c}) = {_WORST} then '{m}'" for c, m in zip(Z_SCORES, METRICS)) + " end"


@query("A19 O4", sql(f"""select {_ARGMAX} as metric, count(*) as "rows" from feats group by 1""", "feats"))
def worst_metric_frequency(spark, sf):
    return evaluation.worst_metric_frequency(views.feature_rows(spark, sf))


def _scaler_sql(select):
    stats = ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in FEATURES)
    return sql(f", split as ({_SPLIT}), stats as (select {stats} from split where split = 'train') {select}", "labelled")


@query("M1", _scaler_sql("select event_id, " + ", ".join(
    f"round(({f} - m_{f}) / case when s_{f} = 0 then 1 else s_{f} end, 6) as {f}" for f in FEATURES)
    + " from split, stats"))
def scaled_features(spark, sf):
    rows = stage(split_features(spark, sf).select("event_id", "split", *FEATURES), "split")
    scaled = Scaler.fit(rows.where("split = 'train'")).transform(rows)
    return scaled.select("event_id", *(F.round(f"{f}_scaled", 6).alias(f) for f in FEATURES))


@query("M2", sql("select event_id, " + ", ".join(f"round({c}, 6) as {c}" for c in Z_SCORES) + " from feats", "feats"))
def inverse_scaling(spark, sf):
    rows = stage(split_features(spark, sf).select("event_id", "split", *FEATURES), "split")
    scaler = Scaler.fit(rows.where("split = 'train'"))
    back = scaler.inverse(scaler.transform(rows))
    return back.select("event_id", *(F.round(f"{c}_raw", 6).alias(c) for c in Z_SCORES))


def _sweep_sql(score, grid, op, order="threshold"):
    return f""", judged as ({_JUDGED}), grid as ({grid}),
    swept as (select threshold, count_if({score} {op} threshold and is_anomaly)::bigint as tp,
        count_if({score} {op} threshold and not is_anomaly)::bigint as fp,
        count_if(not {score} {op} threshold and is_anomaly)::bigint as fn
        from grid, judged where {score} is not null group by threshold),
    quality as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision,
        case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall,
        case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from swept)"""


_OUT = "tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1"
_STEPS = "select 1 + i * 0.25::double as threshold from range(20) t(i)"
_LINES = """select lo + (hi - lo) * i / 39 as threshold from (select min(iforest_score) as lo, max(iforest_score) as hi
            from judged), range(40) t(i)"""
_PERCENTS = """select distinct unnest(quantile_cont(lstm_error, [""" + ", ".join(
    repr((50 + 49.5 * i / 59) / 100) for i in range(60)) + """])) as threshold from judged"""


def _rounded(df, threshold_scale=6):
    return df.select(F.round("threshold", threshold_scale).alias("threshold"), *(
        F.round(c, 6).alias(c) if c in ("precision", "recall", "f1") else F.col(c)
        for c in df.columns if c != "threshold"))


@query("A12 A13 J8", sql(_sweep_sql("zscore_value", _STEPS, ">")
                         + f" select threshold, {_OUT} from quality", "scored", "labelled"))
def zscore_sweep(spark, sf):
    rows = judged(spark, sf)
    return _rounded(evaluation.threshold_sweep(rows, "zscore_value", "is_anomaly", evaluation.step_grid(1.0, 6.0, 0.25)))


@query("A12 A13", sql(_sweep_sql("iforest_score", _LINES, "<")
                      + f" select round(threshold, 6) as threshold, {_OUT} from quality", "scored", "labelled"))
def forest_sweep(spark, sf):
    rows = stage(judged(spark, sf).select("iforest_score", "is_anomaly"), "scores")
    grid = evaluation.linear_grid(rows, "iforest_score")
    return _rounded(evaluation.threshold_sweep(rows, "iforest_score", "is_anomaly", grid, above=False))


@query("A12 A13 U1", sql(_sweep_sql("lstm_error", _PERCENTS, ">")
                         + f" select round(threshold, 6) as threshold, {_OUT} from quality", "scored", "labelled"))
def sequence_sweep(spark, sf):
    rows = stage(judged(spark, sf).select("lstm_error", "is_anomaly"), "scores")
    grid = evaluation.percentile_grid(rows, "lstm_error")
    return _rounded(evaluation.threshold_sweep(rows, "lstm_error", "is_anomaly", grid))


@query("A14", sql(_sweep_sql("zscore_value", _STEPS, ">") + """ select threshold, round(precision, 6) as precision,
    round(recall, 6) as recall, round(f1, 6) as f1 from quality order by f1 desc, threshold limit 1""",
                  "scored", "labelled"))
def best_zscore_threshold(spark, sf):
    sweep = evaluation.threshold_sweep(judged(spark, sf), "zscore_value", "is_anomaly",
                                       evaluation.step_grid(1.0, 6.0, 0.25))
    return _rounded(evaluation.best_threshold(sweep))


def _confusion_sql(name, column):
    return f"""select '{name}' as detector, count_if({column} and is_anomaly)::bigint as tp,
        count_if({column} and not is_anomaly)::bigint as fp, count_if(not {column} and is_anomaly)::bigint as fn,
        count_if(not {column} and not is_anomaly)::bigint as tn from judged"""


DETECTORS = ["zscore_flag", "iforest_flag", "lstm_flag", "ensemble_is_anomaly"]


@query("A15", sql(f""", judged as ({_JUDGED}), c as ({' union all '.join(_confusion_sql(d, d) for d in DETECTORS)})
    select detector, tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
        round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall,
        round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from c""",
                  "scored", "labelled"))
def detection_quality(spark, sf):
    found = evaluation.confusion(judged(spark, sf), "is_anomaly", DETECTORS)
    return found.select("detector", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in (
        "precision", "recall", "f1")))


@query("A16 O6", sql(f"""select anomaly_type, round(avg(ensemble_is_anomaly::int), 6) as recall,
    count(*) as n_readings from ({_JUDGED}) where is_anomaly group by anomaly_type""", "scored", "labelled"))
def recall_by_type(spark, sf):
    return evaluation.recall_by(judged(spark, sf), "is_anomaly", "ensemble_is_anomaly", "anomaly_type").withColumn(
        "recall", F.round("recall", 6))


_DIMENSIONS = ["anomaly_type", "severity", "service_name"]


@query("A17", sql(" union all ".join(
    f"""select '{d}' as dimension, {d} as member, round(avg(ensemble_is_anomaly::int), 6) as recall,
        count(*) as n_readings from ({_JUDGED}) where is_anomaly group by {d}""" for d in _DIMENSIONS),
    "scored", "labelled"))
def recall_report(spark, sf):
    return evaluation.recall_report(judged(spark, sf), "is_anomaly", "ensemble_is_anomaly", _DIMENSIONS).withColumn(
        "recall", F.round("recall", 6))


@query("A17", sql(f"""select category, round(avg(ensemble_is_anomaly::int), 6) as recall, count(*) as n_readings
    from (select s.*, l.is_anomaly, l.category from scored s join labelled l using (event_id)) where is_anomaly group by category""", "scored", "labelled"))
def recall_by_category(spark, sf):
    return evaluation.recall_by(judged(spark, sf), "is_anomaly", "ensemble_is_anomaly", "category").withColumn("recall", F.round("recall", 6))


@query("M16", sql(f""", early as (select cast(severity = 'severe' as int) as y from labelled
        where is_anomaly and progress <= 0.5 and episode_id is not null)
    select sum(y)::bigint as tp, (count(*) - sum(y))::bigint as fp, round(avg(y), 6) as precision,
           1.0::double as recall from early""", "labelled"))
def always_severe_baseline(spark, sf):
    early = labels.early_readings(labelled(spark, sf)).withColumn("always", F.lit(True))
    found = evaluation.confusion(early, "will_be_severe", ["always"])
    return found.select("tp", "fp", F.round("precision", 6).alias("precision"), "recall")


@query("O7", sql(f"""select event_id, service_name, votes from ({_JUDGED}) where ensemble_is_anomaly and not is_anomaly
    order by "timestamp", event_id limit 1""", "scored", "labelled"))
def first_false_positive(spark, sf):
    rows = judged(spark, sf).select("event_id", "timestamp", "service_name", "votes", "ensemble_is_anomaly", "is_anomaly")
    return evaluation.first_false_positive(rows, "is_anomaly", "ensemble_is_anomaly", ["timestamp", "event_id"]).select(
        "event_id", "service_name", "votes")


@query("O5", sql("""select event_id, service_name, round(zscore_value, 6) as zscore_value from scored
    order by zscore_value desc, "timestamp", event_id limit 1""", "scored"))
def most_confident_reading(spark, sf):
    rows = views.scored(spark, sf).select("event_id", "timestamp", "service_name", "zscore_value")
    return evaluation.most_confident(rows, "zscore_value", ["timestamp", "event_id"]).select(
        "event_id", "service_name", F.round("zscore_value", 6).alias("zscore_value"))
