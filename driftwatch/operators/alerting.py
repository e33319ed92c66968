"""From scored readings to alerts."""

from pyspark.sql import Column, DataFrame, functions as F

from driftwatch.catalog import METRICS, RESOLVE_AFTER_SECONDS, TOP_METRICS
from driftwatch.functions.columns import alert_severity, fingerprint, ratio, severity_name, severity_rank
from driftwatch.operators.series import Widths, series, sessions

SNAPSHOT = [
    "host", "ensemble_score", "detected_by", "triggering_metrics", "escalation_probability", "explanation_text",
    "contributing_features",
]


def triggering_metrics(top: int = TOP_METRICS, scale: int = 4) -> Column:
    """The `top` metrics with the largest |z|; payload order decides ties."""
    entries = F.array(*(
        F.struct(
            (-F.abs(f"{m}_z_score")).alias("rank"), F.lit(i).alias("place"), F.lit(m).alias("metric"),
            F.round(f"{m}_z_score", scale).alias("z_score"), F.round(F.col(m).cast("double"), scale).alias("value"))
        for i, m in enumerate(METRICS)
    ))
    best = F.slice(F.array_sort(entries), 1, top)
    return F.transform(best, lambda e: F.struct(e["metric"].alias("metric"), e["z_score"].alias("z_score"),
                                                e["value"].alias("value")))


def detected_by() -> Column:
    return F.struct(
        F.col("votes").cast("int").alias("votes"), F.col("available").cast("int").alias("total_available"),
        F.col("zscore_flag").alias("zscore"), F.col("iforest_flag").alias("iforest"), F.col("lstm_flag").alias("lstm"))


ESCALATION_COLUMNS = {
    "escalation_probability": "double",
    "explanation_text": "string",
    "contributing_features": "array<struct<feature:string,value:double,contribution:double>>",
}


def alert_rows(scored: DataFrame) -> DataFrame:
    """One alert candidate per anomalous reading; escalation columns may be absent."""
    for name, kind in ESCALATION_COLUMNS.items():
        if name not in scored.columns:
            scored = scored.withColumn(name, F.lit(None).cast(kind))
    return scored.where("ensemble_is_anomaly").select(
        fingerprint(F.col("service_name")).alias("fingerprint"),
        "service_name", "host", "timestamp", *(c for c in ("event_id",) if c in scored.columns), "ensemble_score",
        detected_by().alias("detected_by"), triggering_metrics().alias("triggering_metrics"),
        *ESCALATION_COLUMNS,
        alert_severity(F.col("escalation_probability"), F.col("votes"), F.col("available")).alias("severity"),
    )


def alert_id(fp: Column, created_at: Column) -> Column:
    """The same id however often the alert is derived again."""
    return F.sha2(F.concat_ws("|", fp, F.unix_micros(created_at).cast("string")), 256)


def alerts(scored: DataFrame, gap_seconds: float = RESOLVE_AFTER_SECONDS, as_of=None,
           rows_per_chunk: int | None = None, widths: Widths | None = None, order=("timestamp", "event_id")) -> DataFrame:
    """Alert snapshot from scored history.

    Anomalies of one fingerprint that are at most `gap_seconds` apart form one alert; it shows its newest reading, its
    highest severity and the number of readings, and is resolved once it is older than the gap at `as_of` (never, if
    that is not given). Pass the `widths` of the readings, or this step derives the scores twice to measure them.
    """
    rows = alert_rows(scored).withColumn("severity_rank", severity_rank(F.col("severity")))
    s = series(rows, ["fingerprint", "service_name"], list(order), 0, rows_per_chunk, widths)
    merged = sessions(s, gap_seconds, SNAPSHOT, ["severity_rank"])
    return finish_alerts(merged, gap_seconds, as_of)


def finish_alerts(merged: DataFrame, gap_seconds: float, as_of=None) -> DataFrame:
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds).cast("decimal(18,6)"))
    end = F.col("last_seen_at") + gap
    stale = F.lit(False) if as_of is None else end < F.lit(as_of).cast("timestamp")
    return merged.select(
        alert_id(F.col("fingerprint"), F.col("started_at")).alias("id"),
        "fingerprint", "service_name", "host",
        F.lit(None).cast("string").alias("metric_name"),
        F.when(stale, "RESOLVED").otherwise("ACTIVE").alias("status"),
        F.col("started_at").alias("created_at"), "last_seen_at", F.when(stale, end).alias("resolved_at"),
        F.col("occurrence_count").cast("int").alias("occurrence_count"),
        severity_name(F.col("severity_rank")).alias("severity"),
        F.col("ensemble_score").alias("anomaly_score"), "detected_by", "triggering_metrics", *ESCALATION_COLUMNS,
    )


def stale_alerts(snapshot: DataFrame, as_of, gap_seconds: float = RESOLVE_AFTER_SECONDS) -> DataFrame:
    """Active alerts whose last reading is older than the gap."""
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds).cast("decimal(18,6)"))
    return snapshot.where((F.col("status") == "ACTIVE") & (F.col("last_seen_at") < F.lit(as_of).cast("timestamp") - gap))


def merge_alert(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The active alerts after all fresh candidates: inserted, updated or left as they are.

    Candidates of one fingerprint count together. Counts add up, severity never falls, the first and the last time only
    move outwards, and other facts come from the newest of the candidates and the alert. Facts that only one side has are null for the other.
    """
    own = ["occurrence_count", "severity", "created_at", "last_seen_at", "status", "timestamp", "fingerprint"]
    facts = list(dict.fromkeys(c for c in [*existing.columns, *fresh.columns] if c not in own))
    old = existing.where(F.col("status") == "ACTIVE")
    old = old if "last_seen_at" in old.columns else old.withColumn("last_seen_at", F.col("created_at"))
    old = old.select("fingerprint", F.struct(*(c for c in old.columns if c != "fingerprint")).alias("o"))
    new = fresh.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.max(severity_rank(F.col("severity"))).alias("peak"),
        F.max_by(F.struct(*fresh.columns), F.struct("timestamp", *(c for c in ("event_id",) if c in fresh.columns))).alias("f"))
    joined = new.join(old, "fingerprint", "full")
    newer = F.col("o").isNull() | (F.col("f").isNotNull() & (F.col("last") >= F.col("o.last_seen_at")))

    def fact(c):
        from_old = F.col(f"o.{c}") if c in existing.columns else F.lit(None)
        from_new = F.col(f"f.{c}") if c in fresh.columns else F.lit(None)
        if c not in existing.columns:
            return from_new
        return from_old if c not in fresh.columns else F.when(newer, from_new).otherwise(from_old)
    kinds = dict(fresh.dtypes) | dict(existing.dtypes)
    count = F.coalesce("o.occurrence_count", F.lit(0)) + F.coalesce("n", F.lit(0))
    return joined.select(
        "fingerprint", *(fact(c).cast(kinds[c]).alias(c) for c in facts),
        count.cast(kinds["occurrence_count"]).alias("occurrence_count"),
        severity_name(F.greatest("peak", severity_rank(F.col("o.severity")))).alias("severity"),
        F.least("first", "o.created_at").alias("created_at"), F.greatest("last", "o.last_seen_at").alias("last_seen_at"),
        F.lit("ACTIVE").alias("status"))


def latest_snapshot(changelog: DataFrame) -> DataFrame:
    """Current state per alert id from a log of versions, without alerts that were joined to others."""
    newest = changelog.groupBy("id").agg(F.max_by(F.struct(*changelog.columns), F.col("version")).alias("r"))
    return newest.select("r.*").where("status <> 'MERGED'")


def alert_kpis(snapshot: DataFrame, as_of) -> DataFrame:
    """Active alerts, their mean age, mean time to resolve and how often all available detectors agreed."""
    now = F.lit(as_of).cast("timestamp")

    def seconds(a, b):
        return (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    active = F.col("status") == "ACTIVE"
    agreed = F.col("detected_by.votes") == F.col("detected_by.total_available")
    return snapshot.agg(
        F.count_if(active).alias("active_alerts"),
        F.avg(F.when(active, seconds(now, F.col("created_at")))).alias("mean_age_seconds"),
        F.avg(F.when(~active, seconds(F.col("resolved_at"), F.col("created_at")))).alias("mean_seconds_to_resolve"),
        ratio(F.count_if(agreed).cast("double"), F.count("*").cast("double")).alias("agreement_rate"),
    )
