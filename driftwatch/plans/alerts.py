"""Queries: votes, alert rows, alert intervals, alert reports."""

from pyspark.sql import functions as F

from driftwatch.operators import alerting
from driftwatch.operators.series import series, sessions
from driftwatch.plans import views
from driftwatch.plans.ingest import ntz
from driftwatch.plans.registry import query
from driftwatch.plans.views import sql
from driftwatch.sources import tables
from driftwatch.storage import new_path, stage

GAP_HOURS = 6
GAP = GAP_HOURS * 3600.0
_SEVERITY = "case when votes = available then 'CRITICAL' else 'WARNING' end"
_ANOMALIES = f"""select *, case when {_SEVERITY} = 'CRITICAL' then 2 else 1 end as rank from scored
                 where ensemble_is_anomaly"""
_ISLANDS = f"""select *, sum(opens) over (partition by service_name order by "timestamp", event_id) as island from (
    select *, case when "timestamp" - lag("timestamp") over (partition by service_name order by "timestamp", event_id)
                        <= interval {GAP_HOURS} hour then 0 else 1 end as opens from ({_ANOMALIES}))"""
_ALERTS = f"""select concat('multivariate:', service_name) as fingerprint, min("timestamp") as created_at,
    max("timestamp") as last_seen_at, count(*)::int as occurrence_count,
    case max(rank) when 2 then 'CRITICAL' when 1 then 'WARNING' else 'INFO' end as severity,
    arg_max(ensemble_score, event_id) as anomaly_score, arg_max(votes, event_id)::int as votes,
    arg_max(available, event_id)::int as total_available
    from ({_ISLANDS}) group by service_name, island"""
_AS_OF = "(select max(ts) from events)"


@query("M7", sql("""select event_id, votes::int as votes, available::int as available, ensemble_score,
                    ensemble_is_anomaly from scored""", "scored"))
def majority_vote(spark, sf):
    return views.scored(spark, sf).select("event_id", F.col("votes").cast("int"), F.col("available").cast("int"),
                                          "ensemble_score", "ensemble_is_anomaly")


@query("S5 T6", sql("select service_name, count(*) as n, sum(votes)::bigint as votes from scored group by 1", "scored"))
def score_sink(spark, sf):
    rows = views.scored(spark, sf).select("timestamp", "service_name", "votes", "ensemble_score", "ensemble_is_anomaly")
    path = new_path(spark, "scores")
    tables.write_by_date(rows, path)
    stored = tables.read_by_date(spark, path, rows.schema)
    return stored.groupBy("service_name").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


_SCORE_ROW = ["service_name", "host", "zscore_value", "zscore_flag", "iforest_score", "iforest_flag", "lstm_error", "lstm_flag", "votes",
              "ensemble_score"]


@query("S5 T6", sql(f"""select "timestamp", {', '.join(_SCORE_ROW[:2])}, null::varchar as metric_name,
    {', '.join(f'round({c}, 6) as {c}' if c in ('zscore_value', 'iforest_score', 'lstm_error') else c for c in _SCORE_ROW[2:-2])},
    votes::int as votes, ensemble_score, ensemble_is_anomaly as is_anomaly, 'v1' as model_version from scored""", "scored"))
def score_rows_sink(spark, sf):
    """All columns of every score, stored by day and read back."""
    rows = views.scored(spark, sf).select("timestamp", *_SCORE_ROW[:2], F.lit(None).cast("string").alias("metric_name"), *_SCORE_ROW[2:-2],
                                          F.col("votes").cast("int").alias("votes"), "ensemble_score",
                                          F.col("ensemble_is_anomaly").alias("is_anomaly"), F.lit("v1").alias("model_version"))
    path = new_path(spark, "score-rows")
    tables.write_by_date(rows, path)
    rounded = {c: F.round(c, 6) for c in ("zscore_value", "iforest_score", "lstm_error")}
    return tables.read_by_date(spark, path, rows.schema).drop("date").withColumns({"timestamp": ntz("timestamp")} | rounded)


@query("M9 M10 M11 X5 X14", sql(f"""select event_id, concat('multivariate:', service_name) as fingerprint,
    votes::int as votes, available::int as total_available, zscore_flag as zscore, iforest_flag as iforest,
    lstm_flag as lstm, {_SEVERITY} as severity from scored where ensemble_is_anomaly""", "scored"))
def alert_candidates(spark, sf):
    rows = alerting.alert_rows(views.scored(spark, sf))
    return rows.select("event_id", "fingerprint", "detected_by.*", "severity")


def snapshot(spark, sf, as_of=None, **options):
    cut = views.widths(spark, sf, **options)
    return alerting.alerts(views.scored(spark, sf, cut), GAP, as_of, widths=cut)


def _shown(df):
    return df.select("fingerprint", ntz("created_at"), ntz("last_seen_at"), "occurrence_count", "severity",
                     "anomaly_score", F.col("detected_by.votes").alias("votes"),
                     F.col("detected_by.total_available").alias("total_available"))


@query("W14 M12 S7 J5", sql(_ALERTS, "scored"))
def alert_intervals(spark, sf):
    return _shown(snapshot(spark, sf))


@query("W14 M12", sql(_ALERTS, "scored"))
def alert_intervals_in_chunks(spark, sf):
    return _shown(snapshot(spark, sf, rows_per_chunk=50))


@query("W14", sql(f""", high as (select service_name, "timestamp", event_id, case when "timestamp" - lag("timestamp")
        over ({views.W}) <= interval {GAP_HOURS} hour then 0 else 1 end as opens from clean where cpu_usage > 60)
    select service_name, min("timestamp") as started_at, max("timestamp") as last_seen_at, count(*) as occurrence_count
    from (select *, sum(opens) over ({views.W}) as island from high) group by service_name, island""", "clean"))
def busy_intervals(spark, sf):
    rows = views.clean_ticks(spark, sf).where("cpu_usage > 60").select("service_name", "timestamp", "event_id")
    return sessions(series(rows, ["service_name"], ["timestamp", "event_id"], 0), GAP, [], []).select(
        "service_name", ntz("started_at"), ntz("last_seen_at"), "occurrence_count")


def newest_event(spark, sf):
    return views.events(spark, sf).agg(F.max("ts")).first()[0]


@query("F11", sql(f"""select fingerprint, created_at from ({_ALERTS})
    where last_seen_at < {_AS_OF} - interval {GAP_HOURS} hour""", "scored"))
def stale_alerts(spark, sf):
    found = alerting.stale_alerts(snapshot(spark, sf), newest_event(spark, sf), GAP)
    return found.select("fingerprint", ntz("created_at"))


@query("A22", sql(f"""
    select count_if(not stale)::bigint as active_alerts,
        round(avg(case when not stale then epoch(as_of) - epoch(created_at) end), 3) as mean_age_seconds,
        round(avg(case when stale then epoch(last_seen_at) + {GAP_HOURS * 3600} - epoch(created_at) end), 3)
            as mean_seconds_to_resolve,
        round(avg((votes = total_available)::int), 6) as agreement_rate
    from (select *, {_AS_OF} as as_of, last_seen_at + interval {GAP_HOURS} hour < {_AS_OF} as stale from ({_ALERTS}))
    """, "scored"))
def alert_kpis(spark, sf):
    as_of = newest_event(spark, sf)
    row = alerting.alert_kpis(snapshot(spark, sf, as_of), as_of)
    return row.select("active_alerts", F.round("mean_age_seconds", 3).alias("mean_age_seconds"),
                      F.round("mean_seconds_to_resolve", 3).alias("mean_seconds_to_resolve"),
                      F.round("agreement_rate", 6).alias("agreement_rate"))


@query("J5 M12 S7", sql(f""", cut as (select min(ts) + (max(ts) - min(ts)) / 2 as half from events),
    a as ({_ANOMALIES}),
    old as (select service_name, count(*)::int as n, max(rank) as rank, min("timestamp") as first, max("timestamp") as last,
                   arg_max(event_id, struct_pack(t := "timestamp", e := event_id)) as event_id
            from a, cut where "timestamp" <= half or service_name in ('svc-1', 'svc-2') group by 1),
    fresh as (select service_name, count(*)::int as n, max(rank) as rank, min("timestamp") as first, max("timestamp") as last,
                     arg_max(event_id, struct_pack(t := "timestamp", e := event_id)) as event_id
              from a, cut where "timestamp" > half and service_name <> 'svc-2' group by 1)
    select concat('multivariate:', service_name) as fingerprint,
        case when old.last is null or fresh.last >= old.last then fresh.event_id else old.event_id end as event_id,
        coalesce(old.n, 0) + coalesce(fresh.n, 0) as occurrence_count,
        case greatest(coalesce(fresh.rank, 0), coalesce(old.rank, 0)) when 2 then 'CRITICAL' when 1 then 'WARNING'
            else 'INFO' end as severity,
        least(coalesce(old.first, fresh.first), coalesce(fresh.first, old.first)) as created_at,
        greatest(coalesce(old.last, fresh.last), coalesce(fresh.last, old.last)) as last_seen_at
    from fresh full join old using (service_name)""", "scored"))
def alert_merge(spark, sf):
    """The first half of the candidates, and all of two services, are alerts already; one of these two gets no more candidates."""
    candidates = stage(alerting.alert_rows(views.scored(spark, sf)).select(
        "fingerprint", "event_id", "timestamp", "severity"), "candidates")
    first, last = views.events(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    at = F.lit(first + (last - first) / 2)
    rank = alerting.severity_rank(F.col("severity"))
    whole = F.col("fingerprint").isin("multivariate:svc-1", "multivariate:svc-2")
    existing = candidates.where((F.col("timestamp") <= at) | whole).groupBy("fingerprint").agg(
        F.count("*").cast("int").alias("occurrence_count"), alerting.severity_name(F.max(rank)).alias("severity"),
        F.min("timestamp").alias("created_at"), F.max("timestamp").alias("last_seen_at"),
        F.max_by("event_id", F.struct("timestamp", "event_id")).alias("event_id"), F.lit("ACTIVE").alias("status"))
    fresh = candidates.where((F.col("timestamp") > at) & (F.col("fingerprint") != "multivariate:svc-2"))
    return alerting.merge_alert(existing, fresh).select(
        "fingerprint", "event_id", "occurrence_count", "severity", ntz("created_at"), ntz("last_seen_at"))
