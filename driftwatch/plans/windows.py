"""Queries: rolling features, sequences, streaks, scalar functions."""

from pyspark.sql import functions as F

from driftwatch.catalog import FEATURES, METRICS, Z_SCORES
from driftwatch.functions import columns
from driftwatch.operators import alerting, evaluation, rolling
from driftwatch.operators.series import series, streak
from driftwatch.plans import views
from driftwatch.plans.ingest import ntz
from driftwatch.plans.registry import query
from driftwatch.plans.views import ALL_FEATURES, SCALE, W, rolling_sql, sql

KEYS, ORDER = ["service_name"], ["timestamp", "event_id"]
# Few rows per chunk, so that the same results come out of many chunks.
SMALL_CHUNKS = 100


@query("F12 W1 W2 W4", sql(f"select event_id, {ALL_FEATURES} from feats", "feats"))
def rolling_features(spark, sf):
    return views.feature_rows(spark, sf).select("event_id", *FEATURES)


@query("W1 W2 W4", sql(f"select event_id, {ALL_FEATURES} from feats", "feats"))
def rolling_features_in_chunks(spark, sf):
    rows = rolling.features(views.clean_ticks(spark, sf), scale=SCALE, rows_per_chunk=SMALL_CHUNKS)
    return rows.select("event_id", *FEATURES)


_BURST = f"""
    , bursty as (select event_id, "timestamp", service_name, cpu_usage from clean union all
                 select event_id + 1000000000, (select min("timestamp") from clean) + interval 1 day
                        + (event_id % 20000) * interval 1 millisecond, 'svc-0', cpu_usage from clean where event_id % 4 = 0)
    select event_id, {rolling_sql('cpu_usage', 'cpu_usage_')} from bursty"""


@query("W1 W2 W4", sql(_BURST, "clean"))
def rolling_features_of_a_burst(spark, sf):
    """A quarter of all ticks comes once more, within 20 seconds and on one service."""
    rows = views.clean_ticks(spark, sf).select("event_id", "timestamp", "service_name", "cpu_usage")
    day = rows.agg(F.min("timestamp")).first()[0]
    at = F.timestamp_micros(F.unix_micros(F.lit(day)) + 86_400_000_000 + (F.col("event_id") % 20_000) * 1000)
    burst = rows.where("event_id % 4 = 0").select(
        (F.col("event_id") + 1_000_000_000).alias("event_id"), at.alias("timestamp"), F.lit("svc-0").alias("service_name"),
        "cpu_usage")
    s = series(rows.union(burst), KEYS, ORDER, 10, SMALL_CHUNKS)
    s = s.with_columns(rolling.rolling_columns(s, "cpu_usage", "cpu_usage_", scale=SCALE))
    return s.rows().select("event_id", *(f"cpu_usage_{c}" for c in ("rolling_avg", "z_score", "rate_of_change")))


@query("W3", sql("select event_id, " + ", ".join(rolling_sql(m, f"{m}_", std="stddev_pop") for m in METRICS)
                 + " from clean", "clean"))
def rolling_features_population(spark, sf):
    rows = rolling.features(views.clean_ticks(spark, sf), ddof=0, scale=SCALE)
    return rows.select("event_id", *(f for f in FEATURES if f not in METRICS))


_NARROW = 'partition by service_name, metric_name order by "timestamp", event_id'


@query("W1 W2 W4", sql(f"select event_id, metric_name, {rolling_sql('value', '', _NARROW)} from readings", "readings"))
def reading_labels(spark, sf):
    rows = rolling.narrow_features(views.readings(spark, sf), scale=SCALE)
    return rows.select("event_id", "metric_name", "labels.*")


_ROW_SUM = " + ".join(METRICS)


def _sequence_sql(frame):
    over = f"over ({W} rows between {frame})"
    return sql(f"""select event_id, case when n = 20 then round(total, 6) end as total,
                          case when n = 20 then oldest end as oldest
                   from (select event_id, count(*) {over} as n, sum({_ROW_SUM}) {over} as total,
                                first_value(cpu_usage) {over} as oldest from clean)""", "clean")


def _sequences(spark, sf, include_current, **options):
    s = series(views.clean_ticks(spark, sf), KEYS, ORDER, 20, **options)
    s = s.with_columns({"vector": F.array(*METRICS)})
    rows = rolling.add_sequence(s, "vector", include_current=include_current).rows()
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("event_id", F.round(total, 6).alias("total"), F.col("sequence")[0][0].alias("oldest"))


@query("W5", _sequence_sql("19 preceding and current row"))
def live_sequences(spark, sf):
    return _sequences(spark, sf, True)


@query("W6", _sequence_sql("20 preceding and 1 preceding"))
def training_sequences(spark, sf):
    return _sequences(spark, sf, False, rows_per_chunk=SMALL_CHUNKS)


@query("W7", sql("select event_id, round(ensemble_score_trend, 6) as trend from scored", "scored"))
def score_trend(spark, sf):
    return views.scored(spark, sf).select("event_id", F.round("ensemble_score_trend", 6).alias("trend"))


_STREAK = sql(f"""select event_id, sum(on_) over (partition by service_name, island
                      order by "timestamp", event_id rows unbounded preceding)::bigint as streak
    from (select *, sum(1 - on_) over ({W} rows unbounded preceding) as island
          from (select event_id, service_name, "timestamp", case when cpu_usage > 30 then 1 else 0 end as on_
                from clean))""", "clean")


def _streaks(spark, sf, **options):
    rows = views.clean_ticks(spark, sf).select("event_id", "service_name", "timestamp",
                                               (F.col("cpu_usage") > 30).alias("high"))
    return streak(series(rows, KEYS, ORDER, 0, **options), "high", "streak").rows().select("event_id", "streak")


@query("W8", _STREAK)
def anomalous_streak(spark, sf):
    return _streaks(spark, sf)


@query("W8", _STREAK)
def anomalous_streak_in_chunks(spark, sf):
    return _streaks(spark, sf, rows_per_chunk=20)


def _top(i):
    entries = ", ".join(
        f"{{'rank': -abs({m}_z_score), 'place': {k}, 'metric': '{m}', 'z': {m}_z_score}}"
        for k, m in enumerate(METRICS))
    return f"list_sort([{entries}])[{i}]"


@query("W11 O3", sql("select event_id, " + ", ".join(
    f"{_top(i)}.metric as metric_{i}, {_top(i)}.z as z_{i}" for i in (1, 2, 3)) + " from feats", "feats"))
def triggering_metrics(spark, sf):
    rows = views.feature_rows(spark, sf).withColumn("top", alerting.triggering_metrics(scale=SCALE))
    return rows.select("event_id", *(c for i in (1, 2, 3) for c in (
        F.col("top")[i - 1]["metric"].alias(f"metric_{i}"), F.col("top")[i - 1]["z_score"].alias(f"z_{i}"))))


@query("W13", sql("""select "timestamp", event_id, cpu_usage from clean order by "timestamp", event_id limit 2000""",
                  "clean"))
def timeline_start(spark, sf):
    rows = views.clean_ticks(spark, sf).orderBy(*ORDER).limit(2000)
    return rows.select(ntz("timestamp"), "event_id", "cpu_usage")


_HOUR = '(hour("timestamp") + minute("timestamp") / 60.0::double)'
_FACTOR = f"least(greatest(0.3::double + 0.7::double * (0.5::double + 0.5::double * " \
          f"cos(2 * pi() * ({_HOUR} - 14) / 24)), 0.3::double), 1.0::double)"


@query("X9 X10 X11 X12", sql(f"""
    select event_id, round({_HOUR}, 6) as hour_utc, round(sin(2 * pi() * {_HOUR} / 24), 6) + 0.0 as hour_sin,
           round(cos(2 * pi() * {_HOUR} / 24), 6) + 0.0 as hour_cos, round({_FACTOR}, 6) as tod_factor,
           {_FACTOR} < 0.55 as is_off_hours from ticks""", "ticks"))
def time_features(spark, sf):
    rows = columns.with_time_features(views.ticks(spark, sf))
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in ("hour_utc", "hour_sin", "hour_cos",
                                                                     "tod_factor")), "is_off_hours")


@query("X1 X2 X3 X5 X7 X13 X15", sql("""
    select event_id, sec, concat('multivariate:', service_name) as fingerprint, round(cpu_usage / 3, 4) as third,
           greatest(abs(requests_per_sec), abs(cpu_usage)) as largest, cast(cpu_usage > 50 as int) as busy,
           case when error_rate < 0.62 then 'mild' when error_rate < 0.85 then 'moderate' else 'severe' end as severity,
           round(1 / (1 + exp(-error_rate)), 6) as squashed, concat(cast(floor(cpu_usage) as int), '%') as pct
    from ticks_secs""".replace("ticks_secs", "(" + views.VIEWS["secs"].format("ticks") + ")"), "ticks"))
def scalar_functions(spark, sf):
    rows = views.ticks(spark, sf)
    cpu = F.col("cpu_usage")
    return rows.select(
        "event_id",
        columns.nearest_second(F.col("timestamp")).cast("timestamp_ntz").alias("sec"),
        columns.fingerprint(F.col("service_name")).alias("fingerprint"),
        columns.rounded(cpu / 3, 4).alias("third"),
        columns.largest_magnitude(F.col("requests_per_sec"), cpu).alias("largest"),
        (cpu > 50).cast("int").alias("busy"),
        columns.severity_of_intensity(F.col("error_rate")).alias("severity"),
        F.round(columns.sigmoid(F.col("error_rate")), 6).alias("squashed"),
        columns.percent_text(F.floor(cpu) / 100).alias("pct"),
    )


@query("X3 X11 M7 M10", sql(f"""
    select event_id, date_trunc('second', "timestamp") as sec, round({_FACTOR}, 6) as factor,
           votes >= available // 2 + 1 as verdict,
           case when votes = available then 'CRITICAL' else 'WARNING' end as severity
    from scored""", "scored"))
def sql_functions(spark, sf):
    columns.register_sql(spark)
    rows = views.scored(spark, sf)
    return rows.select(
        "event_id",
        F.expr("nearest_second(date_trunc('second', timestamp))").cast("timestamp_ntz").alias("sec"),
        F.expr("round(load_factor(timestamp), 6)").alias("factor"),
        F.expr("ensemble_is_anomaly(votes, available)").alias("verdict"),
        F.expr("alert_severity(CAST(NULL AS DOUBLE), votes, available)").alias("severity"),
    )


@query("X6 X14", sql(" union all ".join(
    f"select '{f}' as feature, '{m}' as metric, count(*) as n, round(sum({f}), 3) as total from feats"
    for m in METRICS for f in (m, f"{m}_z_score", f"{m}_rolling_avg", f"{m}_rate_of_change")), "feats"))
def feature_metrics(spark, sf):
    totals = views.feature_rows(spark, sf).agg(*(F.struct(F.count(f).alias("n"), F.sum(f).alias("t")).alias(f)
                                                 for f in FEATURES))
    rows = totals.unpivot([], FEATURES, "feature", "s")
    return rows.select("feature", columns.metric_of_feature(F.col("feature")).alias("metric"), F.col("s.n").alias("n"),
                       F.round("s.t", 3).alias("total"))


@query("X16", sql("""select event_id, round(((cpu_usage_z_score - memory_usage_z_score)
    * (cpu_usage_z_score - memory_usage_z_score) + (disk_usage_z_score - error_rate_z_score)
    * (disk_usage_z_score - error_rate_z_score)) / 2, 6) as mse from feats""", "feats"))
def squared_difference(spark, sf):
    left = F.array("cpu_usage_z_score", "disk_usage_z_score")
    right = F.array("memory_usage_z_score", "error_rate_z_score")
    return views.feature_rows(spark, sf).select(
        "event_id", F.round(columns.mean_squared_difference(left, right), 6).alias("mse"))


@query("M3 J7", sql(f"""select service_name, count(*) as "rows", count_if(worst > 3.0) as flagged,
    round(max(worst), 6) as worst from (select service_name, greatest({', '.join(f'abs({c})' for c in Z_SCORES)})
    as worst from feats) group by service_name""", "feats"))
def zscore_flags_per_service(spark, sf):
    rows = views.feature_rows(spark, sf).withColumn("worst", evaluation.worst_z())
    return rows.groupBy("service_name").agg(
        F.count("*").alias("rows"), F.count_if(F.col("worst") > 3.0).alias("flagged"),
        F.round(F.max("worst"), 6).alias("worst"))
