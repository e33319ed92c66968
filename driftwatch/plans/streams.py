"""Queries: the streaming jobs, fed with the events in four parts, each in a run of its own from the same checkpoint."""

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftwatch.catalog import ESCALATION_FEATURES, FEATURES, METRICS, SEQUENCE_ROWS
from driftwatch.detectors import bundle as bundles
from driftwatch.detectors.bundle import Bundle
from driftwatch.detectors.forest import Forest, expected_path
from driftwatch.detectors.sequence import GivenComponents
from driftwatch.escalation.explain import Leaves, explain_leaves
from driftwatch.functions.columns import fingerprint
from driftwatch.operators import alerting, rollup
from driftwatch.operators.scaling import Scaler
from driftwatch.plans import alerts as alert_plans, views
from driftwatch.plans import models
from driftwatch.plans.ingest import REASONS_SQL, SHORT_SCALE, _SHORT_SQL, nested, ntz
from driftwatch.plans.registry import query
from driftwatch.plans.views import ALL_FEATURES, sql
from driftwatch.sources import keyed, tables
from driftwatch.storage import new_path
from driftwatch.streaming import alerts, ingest, live, retry, scoring, windows

PARTS = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_in_parts(spark, rows, ts, name, start, write=None):
    """Append the rows to a folder in PARTS time slices and run the stream after each; returns the output folder."""
    path = new_path(spark, name)
    write = write or (lambda df, to: df.write.mode("append").parquet(to))
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    cuts = [first + (last - first) * i / PARTS for i in range(PARTS)] + [last + timedelta(seconds=1)]
    for low, high in zip(cuts, cuts[1:]):
        write(rows.where((F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high))), f"{path}/in")
        start(f"{path}/in", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return f"{path}/out"


def _intake(spark, sf, on_invalid):
    return run_in_parts(
        spark, nested(views.ticks(spark, sf)), "timestamp", "intake",
        lambda source, out, checkpoint: ingest.start_intake(
            tables.read_payload_stream(spark, source), out, checkpoint, on_invalid), tables.append_json)


_AT = "\"timestamp\", service_name, host"


@query("S1 S2 T1 T7 T9", sql(f"""select {_AT}, {REASONS_SQL} = '' as accepted, {REASONS_SQL} as reasons from ticks""",
                             "ticks"))
def stream_intake(spark, sf):
    out = _intake(spark, sf, "reject")
    shown = [ntz("timestamp"), "service_name", "host"]
    good = spark.read.parquet(f"{out}/ticks").select(*shown, F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
    bad = spark.read.parquet(f"{out}/quarantine").select(
        *shown, F.lit(False).alias("accepted"), F.array_join("reasons", "; ").alias("reasons"))
    return good.unionByName(bad)


@query("T1 F1 F2", sql(f"select {_AT}, {', '.join(METRICS)} from clean", "clean"))
def stream_repair(spark, sf):
    out = _intake(spark, sf, "repair")
    return spark.read.parquet(f"{out}/ticks").select(ntz("timestamp"), "service_name", "host", *METRICS)


def event_stream(spark, source, sample):
    return spark.readStream.schema(sample.schema).parquet(source)


def scored_stream(spark, sf, **options):
    rows = views.clean_ticks(spark, sf)
    only_z = Bundle(scaler=Scaler(tuple(FEATURES), (0.0,) * len(FEATURES), (1.0,) * len(FEATURES)),
                    zscore_threshold=3.0)
    return run_in_parts(spark, rows, "timestamp", "scoring", lambda source, out, checkpoint: scoring.start_scoring(
        event_stream(spark, source, rows), out, checkpoint, only_z, scale=views.SCALE, **options))


@query("T1 T2 T10 T7", sql(f"select event_id, {ALL_FEATURES} from feats", "feats"))
def stream_features(spark, sf):
    return scoring.latest_scores(spark, scored_stream(spark, sf)).select("event_id", *FEATURES)


_W = views.W


@query("T3 T6 W7 W8", sql(f"""
    , z as (select *, (zscore_value > 3.0)::int as flag from scored0),
    i as (select *, sum(1 - flag) over ({_W} rows unbounded preceding) as island,
                 flag - lag(flag, 5) over ({_W}) as trend from z)
    select event_id, round(zscore_value, 6) as zscore_value, flag = 1 as ensemble_is_anomaly,
           flag::double as ensemble_score, trend::double as trend,
           sum(flag) over (partition by service_name, island order by "timestamp", event_id rows unbounded preceding)
               ::bigint as streak from i""", "scored0"))
def stream_scores(spark, sf):
    rows = scoring.latest_scores(spark, scored_stream(spark, sf, rows_per_chunk=100))
    return rows.select("event_id", F.round("zscore_value", 6).alias("zscore_value"), "ensemble_is_anomaly",
                       "ensemble_score", F.col("ensemble_score_trend").alias("trend"),
                       F.col("consecutive_anomalous_ticks").alias("streak"))


@query("T8", sql("""
    , half as (select min(ts) + (max(ts) - min(ts)) / 2 as moment from events)
    select service_name, count(*) as late_rows from clean, half
    where "timestamp" <= moment
          and service_name in (select service_name from clean, half where "timestamp" > moment)
    group by service_name""", "clean"))
def stream_late_rows(spark, sf):
    """The newer half of the ticks arrives first, so the older half is late."""
    rows = views.clean_ticks(spark, sf)
    first, last = views.events(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    newer = F.col("timestamp") > F.lit(first + (last - first) / 2)
    path = new_path(spark, "late")
    for part in (rows.where(newer), rows.where(~newer)):
        part.write.mode("append").parquet(f"{path}/in")
        scoring.start_scoring(event_stream(spark, f"{path}/in", rows), f"{path}/out", f"{path}/checkpoint",
                              Bundle()).awaitTermination()
    return spark.read.parquet(f"{path}/out/late").groupBy("service_name").agg(F.count("*").alias("late_rows"))


_CLOSED = "(select max(ts) - interval 10 minute from events)"


@query("T4 S6 A2", sql(f"""select * from (select date_trunc('hour', "timestamp") as window_start, service_name,
    metric_name, {_SHORT_SQL} from readings group by 1, 2, 3)
    where window_start + interval 1 hour <= {_CLOSED}""", "readings"))
def stream_summaries(spark, sf):
    rows = views.clean_ticks(spark, sf)
    out = run_in_parts(spark, rows, "timestamp", "summaries", lambda source, out, checkpoint: windows.start_append(
        windows.summary_stream(event_stream(spark, source, rows), "1 hour", scale=SHORT_SCALE), out, checkpoint))
    return spark.read.parquet(out).select(
        ntz("window_start"), "service_name", "metric_name", "avg_value", "min_value", "max_value", "sample_count")


_HIGH = f"""select service_name, "timestamp", event_id, cpu_usage, host,
    case when "timestamp" - lag("timestamp") over ({_W}) <= interval {alert_plans.GAP_HOURS} hour then 0 else 1 end
        as opens from clean where cpu_usage > 60"""
_HIGH_ALERTS = f"""select service_name, min("timestamp") as started_at, max("timestamp") as last_seen_at,
    count(*) as occurrence_count, max(cpu_usage >= 100) as critical, arg_max(cpu_usage, event_id) as score
    from (select *, sum(opens) over ({_W}) as island from ({_HIGH})) group by service_name, island"""


@query("T11 W14", sql(f"""select service_name, started_at, last_seen_at, occurrence_count from ({_HIGH_ALERTS})
    where last_seen_at + interval {alert_plans.GAP_HOURS} hour
          <= (select max("timestamp") - interval 10 minute from clean where cpu_usage > 60)""", "clean"))
def stream_closed_intervals(spark, sf):
    rows = views.clean_ticks(spark, sf).where("cpu_usage > 60").select("service_name", "timestamp", "event_id")
    out = run_in_parts(spark, rows, "timestamp", "intervals", lambda source, out, checkpoint: windows.start_append(
        windows.closed_intervals(event_stream(spark, source, rows), f"{alert_plans.GAP_HOURS} hours"), out, checkpoint))
    return spark.read.parquet(out).select("service_name", ntz("started_at"), ntz("last_seen_at"), "occurrence_count")


@query("T5 S7 J5 M12", sql(f"""select concat('multivariate:', service_name) as fingerprint, started_at as created_at,
    last_seen_at, occurrence_count, case when critical then 'CRITICAL' else 'WARNING' end
    as severity, score as anomaly_score from ({_HIGH_ALERTS})""", "clean"))
def stream_alerts(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = views.clean_ticks(spark, sf).where("cpu_usage > 60").select(
        fingerprint(F.col("service_name")).alias("fingerprint"), "timestamp", "host",
        F.col("cpu_usage").alias("ensemble_score"),
        F.when(F.col("cpu_usage") >= 100, "CRITICAL").otherwise("WARNING").alias("severity"))
    out = run_in_parts(spark, rows, "timestamp", "alerts", lambda source, out, checkpoint: windows.start_append(
        alerts.alert_changes(event_stream(spark, source, rows), alert_plans.GAP), out, checkpoint))
    snapshot = alerting.latest_snapshot(spark.read.parquet(out))
    return snapshot.select("fingerprint", ntz("created_at"), ntz("last_seen_at"), "occurrence_count", "severity",
                           "anomaly_score")


_SNAPSHOT_SQL = sql(f"""select concat('multivariate:', service_name) as fingerprint, started_at as created_at,
    last_seen_at, occurrence_count, case when critical then 'CRITICAL' else 'WARNING' end
    as severity, score as anomaly_score from ({_HIGH_ALERTS})""", "clean")


@query("S7 T5 T7", _SNAPSHOT_SQL)
def stream_alert_upserts(spark, sf):
    """The change log of the alerts in four batches, of which one is repeated, upserted into a stored snapshot by alert id."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = views.clean_ticks(spark, sf).where("cpu_usage > 60").select(
        fingerprint(F.col("service_name")).alias("fingerprint"), "timestamp", "host",
        F.col("cpu_usage").alias("ensemble_score"),
        F.when(F.col("cpu_usage") >= 100, "CRITICAL").otherwise("WARNING").alias("severity"))
    store = keyed.KeyedStore(new_path(spark, "alert-snapshot"), ("id",))

    def write(batch, batch_id):
        for _ in range(1 + (batch_id == 1)):
            keyed.upsert(store, batch, "version", batch_id)

    def start(source, _, checkpoint):
        changes = alerts.alert_changes(event_stream(spark, source, rows), alert_plans.GAP)
        return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    run_in_parts(spark, rows, "timestamp", "alert-upserts", start)
    schema = alerts.CHANGE_LOG
    return store.read(spark, schema).where("status <> 'MERGED'").select(
        "fingerprint", ntz("created_at"), ntz("last_seen_at"), "occurrence_count", "severity", "anomaly_score")


# A bundle and an escalation model of a few given numbers, so that what the live stream does with them is plain SQL as well.
_FOREST = [(0, 0, FEATURES.index("cpu_usage"), 90.0, 1, 2, 0.0), (0, 1, 0, np.inf, 1, 1, 8.0), (0, 2, 0, np.inf, 2, 2, 2.0),
           (1, 0, FEATURES.index("request_latency_ms_z_score"), 2.0, 1, 2, 0.0), (1, 1, 0, np.inf, 1, 1, 7.0), (1, 2, 0, np.inf, 2, 2, 3.0)]
_OFFSET, _Z, _ERROR = -0.7, 3.0, 12000.0
# feature: (cut, log-odds up to the cut, share of rows, log-odds above)
_STUMPS = {"votes": (2.5, -0.4, 0.7, 0.9), "zscore_value": (4.0, -0.6, 0.6, 0.8), "iforest_score": (-0.1, 0.7, 0.25, -0.3),
           "lstm_error": (20000.0, -0.2, 0.5, 0.5)}


def given_bundle():
    nodes = pd.DataFrame(_FOREST, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])
    average = tuple(SEQUENCE_ROWS ** -0.5 if k % len(FEATURES) == 0 else 0.0 for k in range(SEQUENCE_ROWS * len(FEATURES)))
    return Bundle(
        scaler=Scaler(tuple(FEATURES), (0.0,) * len(FEATURES), (1.0,) * len(FEATURES)), zscore_threshold=_Z,
        forest=Forest(nodes, 256, _OFFSET), forest_threshold=0.0, sequence=GivenComponents((average,)), sequence_threshold=_ERROR)


def given_escalation():
    value, feature, low, high, share = [], [], [], [], []
    for name, (cut, below, part, above) in _STUMPS.items():
        for v, limits, p in ((below, (-np.inf, cut), part), (above, (cut, np.inf), 1 - part)):
            value.append(v)
            feature.append([ESCALATION_FEATURES.index(name), 0, 0])
            low.append([limits[0], -np.inf, -np.inf])
            high.append([limits[1], np.inf, np.inf])
            share.append([p, 1.0, 1.0])
    return Leaves(np.array(value), np.array(feature), np.array(low), np.array(high), np.array(share))


def _step(name, missing):
    cut, below, part, above = _STUMPS[name]
    return f"(case when coalesce({name}, {missing}) <= {cut} then {below}::double else {above}::double end)", below * part + above * (1 - part)


_STEPS = {f: _step(f, {"iforest_score": -10, "lstm_error": -1}.get(f, 0)) for f in _STUMPS}
_SQUARES = " + ".join(f"{f} * {f}" for f in FEATURES)
_LAST = f"over ({_W} rows between {SEQUENCE_ROWS - 1} preceding and current row)"
_GIVEN_SQL = f"""
    , given0 as (select *, {views._WORST} as zscore_value,
        -power(2, -((case when cpu_usage <= 90 then 8 else 2 end) + (case when request_latency_ms_z_score <= 2 then 7 else 3 end))
                   / 2.0::double / {expected_path(256)}) - ({_OFFSET}) as iforest_score,
        case when count(*) {_LAST} = {SEQUENCE_ROWS} then greatest(sum({_SQUARES}) {_LAST}
             - power(sum(cpu_usage) {_LAST}, 2) / {SEQUENCE_ROWS}, 0) / {SEQUENCE_ROWS * len(FEATURES)} end as lstm_error from feats),
    given1 as (select *, zscore_value > {_Z} as zscore_flag, iforest_score < 0 as iforest_flag, coalesce(lstm_error > {_ERROR}, false) as lstm_flag,
        2 + (lstm_error is not null)::int as available from given0),
    given2 as (select *, zscore_flag::int + iforest_flag::int + lstm_flag::int as votes from given1),
    given3 as (select *, round(votes::double / available, 4) as ensemble_score, votes >= available // 2 + 1 as ensemble_is_anomaly from given2),
    given4 as (select *, {' + '.join(s for s, _ in _STEPS.values())} as margin from given3 where ensemble_is_anomaly),
    given5 as (select *, 1 / (1 + exp(-margin)) as p, list_sort([{', '.join(
        f"{{'size': -abs({s} - ({mean})), 'place': {i}, 'feature': '{f}', 'c': {s} - ({mean})}}"
        for i, (f, (s, mean)) in enumerate(_STEPS.items()))}]) as top from given4),
    given as (select *, case when p >= 0.5 then 2 when p >= 0.2 then 1 else 0 end as rank,
        concat('This incident looks ', case when p >= 0.5 then 'likely' else 'unlikely' end, ' to become severe (',
            cast(cast(round(p * 100, 0) as int) as varchar), '% confidence), mainly because ', {models._text(1)}, ', and ',
            {models._text(2)}, '. A smaller factor: ', {models._text(3)}, '.') as explanation_text from given5),
    opened as (select *, case when "timestamp" - lag("timestamp") over ({_W}) <= interval {alert_plans.GAP_HOURS} hour then 0 else 1 end as opens
               from given),
    islands as (select *, sum(opens) over ({_W}) as island from opened)"""
_METRIC_SIZES = "list_sort([" + ", ".join(
    f"{{'size': -abs({m}_z_score), 'place': {i}, 'metric': '{m}'}}" for i, m in enumerate(METRICS)) + "])"
_SHOWN = ["host", "ensemble_score", "votes", "available", "zscore_flag", "iforest_flag", "lstm_flag", "explanation_text"]


@query("T1 T3 T5 T6 M7 M9 M10 M11 M18 M19 S7 W7 W8", sql(_GIVEN_SQL + f"""
    select concat('multivariate:', service_name) as fingerprint, min("timestamp") as created_at, max("timestamp") as last_seen_at,
        count(*)::int as occurrence_count, case max(rank) when 2 then 'CRITICAL' when 1 then 'WARNING' else 'INFO' end as severity,
        {', '.join(f'arg_max({c}, event_id) as {c}' for c in _SHOWN)},
        round(arg_max(p, event_id), 4) as escalation_probability,
        arg_max(concat_ws(',', m[1].metric, m[2].metric, m[3].metric), event_id) as metrics,
        arg_max(top[1].feature, event_id) as first_feature, round(arg_max(top[1].c, event_id), 4) as first_contribution
    from (select *, {_METRIC_SIZES} as m from islands) group by service_name, island""", "feats"))
def stream_explained_alerts(spark, sf):
    """Payloads in, alerts with votes, metrics, probability and sentence out, through all three detectors and the escalation model."""
    path = {}

    def start(source, out, checkpoint):
        path["out"] = out
        return live.start_live(tables.read_payload_stream(spark, source), out, checkpoint, given_bundle(), given_escalation(),
                               gap_seconds=alert_plans.GAP, on_invalid="repair", scale=views.SCALE)

    run_in_parts(spark, nested(views.ticks(spark, sf)), "timestamp", "live", start, tables.append_json)
    found = live.stored_alerts(spark, path["out"], alert_plans.GAP)
    by = F.col("detected_by")
    return found.select(
        "fingerprint", ntz("created_at"), ntz("last_seen_at"), "occurrence_count", "severity", "host",
        F.col("anomaly_score").alias("ensemble_score"), by["votes"].alias("votes"), by["total_available"].alias("available"),
        by["zscore"].alias("zscore_flag"), by["iforest"].alias("iforest_flag"), by["lstm"].alias("lstm_flag"), "explanation_text",
        F.round("escalation_probability", 4).alias("escalation_probability"),
        F.array_join(F.transform("triggering_metrics", lambda m: m["metric"]), ",").alias("metrics"),
        F.col("contributing_features")[0]["feature"].alias("first_feature"),
        F.col("contributing_features")[0]["contribution"].alias("first_contribution"))


@query("M5 M6 M7 M8 W7 W8", sql(_GIVEN_SQL + f""",
    streaks as (select *, sum(1 - ensemble_is_anomaly::int) over ({_W} rows unbounded preceding) as run,
                ensemble_score - lag(ensemble_score, 5) over ({_W}) as trend from given3)
    select event_id, round(zscore_value, 6) as zscore_value, round(iforest_score, 9) as iforest_score, round(lstm_error, 3) as lstm_error,
        zscore_flag, iforest_flag, lstm_flag, votes::int as votes, available::int as available, ensemble_score, ensemble_is_anomaly,
        round(trend, 4) as trend, sum(ensemble_is_anomaly::int) over (partition by service_name, run order by "timestamp", event_id
            rows unbounded preceding)::bigint as streak from streaks""", "feats"))
def replay_of_given_models(spark, sf):
    """The whole history through a forest of a given node table and a sequence detector of given components."""
    rows = bundles.replay(views.clean_ticks(spark, sf), given_bundle(), widths=views.widths(spark, sf), scale=views.SCALE, keep=[])
    return rows.select(
        "event_id", F.round("zscore_value", 6).alias("zscore_value"), F.round("iforest_score", 9).alias("iforest_score"),
        F.round("lstm_error", 3).alias("lstm_error"), "zscore_flag", "iforest_flag", "lstm_flag", F.col("votes").cast("int").alias("votes"),
        F.col("available").cast("int").alias("available"), "ensemble_score", "ensemble_is_anomaly",
        F.round("ensemble_score_trend", 4).alias("trend"), F.col("consecutive_anomalous_ticks").alias("streak"))


@query("M15 M17 M18", sql(_GIVEN_SQL + f"""
    select event_id, round(margin, 6) as margin, round(p, 4) as escalation_probability, explanation_text,
        {', '.join(f'round({s} - ({mean}), 6) as {f}' for f, (s, mean) in _STEPS.items())} from given""", "feats"))
def contributions_of_given_leaves(spark, sf):
    """Shapley contributions of the leaves of a given model, for every anomalous reading."""
    rows = bundles.replay(views.clean_ticks(spark, sf), given_bundle(), widths=views.widths(spark, sf), scale=views.SCALE, keep=[])
    told = explain_leaves(rows.where("ensemble_is_anomaly"), given_escalation())
    return told.select("event_id", F.round("escalation_margin", 6).alias("margin"), "escalation_probability", "explanation_text",
                       *(F.round(f"contributions.{f}", 6).alias(f) for f in _STEPS))


@query("T4 T8 S6", sql(f"""select date_trunc('hour', "timestamp") as window_start, service_name, metric_name, {_SHORT_SQL}
    from readings group by all""", "readings"))
def stream_summary_upserts(spark, sf):
    """Hourly summaries that are corrected by rows which come up to eight minutes late, and that are complete to the last window."""
    rows = views.clean_ticks(spark, sf).withColumn("arrives", F.col("timestamp") + F.make_dt_interval(mins=F.pmod("event_id", F.lit(3)) * 4))
    path = {}

    def start(source, out, checkpoint):
        path["out"] = out
        return windows.start_summary_upserts(event_stream(spark, source, rows).drop("arrives"), out, checkpoint, "1 hour", scale=SHORT_SCALE)

    run_in_parts(spark, rows, "arrives", "summary-upserts", start)
    shown = rollup.window_summary_of_ticks(rows, "1 hour", SHORT_SCALE)
    found = windows.stored_summaries(spark, path["out"], shown.schema)
    return found.select(ntz("window_start"), "service_name", "metric_name", "avg_value", "min_value", "max_value", "sample_count")


@query("T7 T1", sql("""
    , cut as (select min("timestamp") as low, max("timestamp") - min("timestamp") as span from ticks),
    placed as (select service_name, case when "timestamp" >= low + span / 4 * 2 and "timestamp" < low + span / 4 * 3 then 'dead' else 'taken' end as went
               from ticks, cut)
    select service_name, went, count(*) as n, case when went = 'dead' then 3 end as attempts from placed group by all""", "ticks"))
def stream_retries(spark, sf):
    """Four batches, of which the second passes at the third attempt and the third never does."""
    tries = {}

    def start(source, out, checkpoint):
        intake = ingest.take_in(out, "repair")

        def step(batch, batch_id):
            tries[batch_id] = tries.get(batch_id, 0) + 1
            if batch_id == 2 or (batch_id == 1 and tries[1] < 3):
                raise RuntimeError("the step broke off")
            intake(batch, batch_id)
        return tables.read_payload_stream(spark, source).writeStream.foreachBatch(
            retry.retrying(step, out, 3, 0.01)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    out = run_in_parts(spark, nested(views.ticks(spark, sf)), "timestamp", "retries", start, tables.append_json)
    taken = spark.read.parquet(f"{out}/ticks").groupBy("service_name").agg(
        F.lit("taken").alias("went"), F.count("*").alias("n"), F.lit(None).cast("int").alias("attempts"))
    dead = spark.read.parquet(f"{out}/dead").groupBy("service_name").agg(
        F.lit("dead").alias("went"), F.count("*").alias("n"), F.max("attempts").alias("attempts"))
    return taken.unionByName(dead)
