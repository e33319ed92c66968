"""The monitoring tables that the registered queries run on, derived from the `events` table.

Every view exists twice: as a DataFrame and as SQL for the check against another engine.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwatch.catalog import FEATURES, METRIC_BOUNDS, METRICS, Z_SCORES
from driftwatch.functions.columns import vote
from driftwatch.operators.cleaning import repair, to_narrow
from driftwatch.operators.evaluation import worst_z
from driftwatch.operators.rolling import add_features, add_trend, features
from driftwatch.operators.series import Widths, measure, series

SCALE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp (the file has none; the session zone is UTC)."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ticks_of(ev: DataFrame) -> DataFrame:
    """One wide tick per event, with missing memory values and values outside the bounds."""
    return ev.selectExpr(
        "event_id",
        "ts AS timestamp",
        "concat('svc-', string(user_id % 8)) AS service_name",
        "concat('host-', string(user_id % 8)) AS host",
        "value AS cpu_usage",
        "CASE WHEN event_id % 97 <> 0 THEN value * 0.5D + 20D END AS memory_usage",
        "value * 10D AS request_latency_ms",
        "value - 5D AS requests_per_sec",
        "value / 200D AS error_rate",
        "double(floor(value)) AS db_connections",
        "40D + double(event_id % 1000) * 0.05D AS disk_usage",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(events(spark, sf_dir))


def clean_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(ticks(spark, sf_dir))


def widths(spark: SparkSession, sf_dir: str, rows_per_chunk: int | None = None) -> Widths:
    """Chunk widths per service, measured on the raw ticks and valid for everything derived from them."""
    return measure(ticks(spark, sf_dir), ["service_name"], "timestamp", rows_per_chunk)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_narrow(clean_ticks(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(clean_ticks(spark, sf_dir), scale=SCALE, widths=widths(spark, sf_dir))


# A category of the scenario catalogue for each kind of event.
CATEGORY = ("CASE event_type WHEN 'click' THEN 'spike' WHEN 'error' THEN 'plateau' WHEN 'purchase' THEN 'surge' "
            "WHEN 'signup' THEN 'trend' ELSE 'dip' END")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels; every 500th event has a second line with the same key."""
    kind = "(day(ts) + user_id % 8) % 3"
    return events(spark, sf_dir).selectExpr(
        "ts AS timestamp",
        "concat('svc-', string(user_id % 8)) AS service_name",
        "value > 100 AS is_anomaly",
        "CASE WHEN value > 100 THEN event_type ELSE 'normal' END AS anomaly_type",
        f"CASE WHEN value > 100 THEN {CATEGORY} END AS category",
        "CASE WHEN value > 100 THEN concat('ep-', string(user_id % 8), '-', string(day(ts))) END AS episode_id",
        f"CASE WHEN value <= 100 THEN 'none' WHEN {kind} = 0 THEN 'mild' WHEN {kind} = 1 THEN 'moderate'"
        " ELSE 'severe' END AS severity",
        "CASE WHEN value > 100 THEN hour(ts) / 24D ELSE 0D END AS progress",
        "explode(CASE WHEN event_id % 500 = 0 THEN array(0, 1) ELSE array(0) END) AS copy_no",
    )


# Stand-in detector values for queries about voting and alerts, so that their inputs are plain SQL as well.
def detector_values() -> dict[str, Column]:
    return {
        "zscore_value": worst_z(),
        "iforest_score": 0.3 - F.col("cpu_usage") / 200.0,
        "lstm_error": F.abs("request_latency_ms_rate_of_change") / 1000.0,
    }


def detector_flags() -> dict[str, Column]:
    return {
        "zscore_flag": F.col("zscore_value") > 3.0,
        "iforest_flag": F.col("iforest_score") < 0.0,
        "lstm_flag": F.coalesce(F.col("lstm_error") > 0.8, F.lit(False)),
    }


def scored(spark: SparkSession, sf_dir: str, cut: Widths | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Feature rows with stand-in detector values, votes and the score trend; warm-up rows lack `lstm_error`.

    `rows` are the clean ticks with further columns, which are passed on.
    """
    rows = clean_ticks(spark, sf_dir) if rows is None else rows
    cut = cut or widths(spark, sf_dir)
    s = series(rows, ["service_name"], ["timestamp", "event_id"], 25, widths=cut)
    s = add_features(s, scale=SCALE)
    s = s.with_columns(detector_values())
    seen = F.count("*").over(s.last(20))
    s = s.with_columns({"lstm_error": F.when(seen == 20, F.col("lstm_error"))})
    s = s.with_columns(detector_flags())
    votes, available, score, verdict = vote(
        [F.col(c) for c in ("zscore_flag", "iforest_flag", "lstm_flag")],
        [F.col(c) for c in ("zscore_value", "iforest_score", "lstm_error")])
    s = s.with_columns({"votes": votes, "available": available, "ensemble_score": score, "ensemble_is_anomaly": verdict})
    return add_trend(s, "ensemble_score").rows()


# ---- the same in SQL -------------------------------------------------------------------------------------------

def _clip(metric: str) -> str:
    low, high = METRIC_BOUNDS[metric]
    x = f"greatest(coalesce(cast({metric} as double), cast({low} as double)), cast({low} as double))"
    return x if high is None else f"least({x}, cast({high} as double))"


W = "partition by service_name order by \"timestamp\", event_id"


def rolling_sql(value: str, prefix: str, partition: str = W, rows: int = 10, std: str = "stddev_samp") -> str:
    frame = f"over ({partition} rows between {rows} preceding and 1 preceding)"
    mean, dev = f"avg({value}) {frame}", f"{std}({value}) {frame}"
    return (
        f"round(coalesce({mean}, {value}), 6) as {prefix}rolling_avg, "
        f"case when count({value}) {frame} >= 2 and {dev} > 0.0001 "
        f"then round(({value} - {mean}) / {dev}, 6) else 0.0 end as {prefix}z_score, "
        f"round(coalesce({value} - lag({value}) over ({partition}), 0.0), 6) as {prefix}rate_of_change"
    )


_WORST = "greatest(" + ", ".join(f"abs({c})" for c in Z_SCORES) + ")"

VIEWS = {
    "ticks": """
        select event_id, "ts" as "timestamp",
               concat('svc-', cast(user_id % 8 as varchar)) as service_name,
               concat('host-', cast(user_id % 8 as varchar)) as host,
               value as cpu_usage,
               case when event_id % 97 <> 0 then value * cast(0.5 as double) + cast(20 as double) end as memory_usage,
               value * cast(10 as double) as request_latency_ms,
               value - cast(5 as double) as requests_per_sec,
               value / cast(200 as double) as error_rate,
               cast(floor(value) as double) as db_connections,
               cast(40 as double) + cast(event_id % 1000 as double) * cast(0.05 as double) as disk_usage
        from events""",
    "clean": 'select event_id, "timestamp", service_name, host, '
             + ", ".join(f"{_clip(m)} as {m}" for m in METRICS) + " from ticks",
    "readings": " union all ".join(
        f"select event_id, \"timestamp\", service_name, host, '{m}' as metric_name, {m} as value from clean"
        for m in METRICS),
    "feats": "select *, " + ", ".join(rolling_sql(m, f"{m}_") for m in METRICS) + " from clean",
    "truth": f"""
        select e."ts" as "timestamp",
               concat('svc-', cast(e.user_id % 8 as varchar)) as service_name,
               e.value > 100 as is_anomaly,
               case when e.value > 100 then e.event_type else 'normal' end as anomaly_type,
               case when e.value > 100 then {CATEGORY} end as category,
               case when e.value > 100 then concat('ep-', cast(e.user_id % 8 as varchar), '-',
                    cast(day(e."ts") as varchar)) end as episode_id,
               case when e.value <= 100 then 'none'
                    when (day(e."ts") + e.user_id % 8) % 3 = 0 then 'mild'
                    when (day(e."ts") + e.user_id % 8) % 3 = 1 then 'moderate' else 'severe' end as severity,
               case when e.value > 100 then cast(hour(e."ts") as double) / cast(24 as double)
                    else cast(0 as double) end as progress,
               d.copy_no
        from events e join (select 0 as copy_no union all select 1) d on d.copy_no = 0 or e.event_id % 500 = 0""",
    "secs": """
        select *, case when extract(microsecond from "timestamp") % 1000000 > 500000
                         or (extract(microsecond from "timestamp") % 1000000 = 500000
                             and cast(extract(second from "timestamp") as bigint) % 2 = 1)
                       then date_trunc('second', "timestamp") + interval 1 second
                       else date_trunc('second', "timestamp") end as sec
        from {0}""",
    "labels1": """
        select * exclude (rn) from (
          select *, row_number() over (partition by sec, service_name order by "timestamp", copy_no) as rn
          from truth_secs) where rn = 1""",
    "labelled": """
        select f.*, coalesce(l.is_anomaly, false) as is_anomaly, l.anomaly_type, l.category, l.severity, l.progress, l.episode_id
        from feats_secs f left join labels1 l on f.sec = l.sec and f.service_name = l.service_name""",
    "scored0": f"""
        select *, {_WORST} as zscore_value, 0.3::double - cpu_usage / 200.0::double as iforest_score,
               case when count(*) over ({W} rows between 19 preceding and current row) = 20
                    then abs(request_latency_ms_rate_of_change) / 1000.0::double end as lstm_error
        from feats""",
    "scored1": """
        select *, zscore_value > 3.0 as zscore_flag, iforest_score < 0.0 as iforest_flag,
               coalesce(lstm_error > 0.8, false) as lstm_flag,
               2 + case when lstm_error is null then 0 else 1 end as available
        from scored0""",
    "scored2": """
        select *, zscore_flag::int + iforest_flag::int + lstm_flag::int as votes from scored1""",
    "scored3": """
        select *, round(votes::double / available, 4) as ensemble_score,
               votes >= available // 2 + 1 as ensemble_is_anomaly
        from scored2""",
    "scored": f"""
        select *, ensemble_score - lag(ensemble_score, 5) over ({W}) as ensemble_score_trend from scored3""",
}
NEEDS = {
    "ticks": [], "clean": ["ticks"], "readings": ["clean"], "feats": ["clean"], "truth": [],
    "truth_secs": ["truth"], "feats_secs": ["feats"], "clean_secs": ["clean"], "labels1": ["truth_secs"], "labelled": ["feats_secs", "labels1"],
    "scored0": ["feats"], "scored1": ["scored0"], "scored2": ["scored1"], "scored3": ["scored2"], "scored": ["scored3"],
}


def sql(body: str, *views: str) -> str:
    """`body` behind the definitions of the views it uses."""
    ordered: list[str] = []

    def add(view):
        for needed in NEEDS[view]:
            add(needed)
        if view not in ordered:
            ordered.append(view)
    for view in views:
        add(view)

    def text(view):
        return VIEWS["secs"].format(view.removesuffix("_secs")) if view.endswith("_secs") else VIEWS[view]
    return "with " + ", ".join(f"{v} as ({text(v)})" for v in ordered) + " " + body if ordered else body


SEVEN = ", ".join(METRICS)
ALL_FEATURES = ", ".join(FEATURES)
