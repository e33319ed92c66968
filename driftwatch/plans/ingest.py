"""Queries: reading, validating, repairing, reshaping, history and summaries."""

from pyspark.sql import functions as F

from driftwatch.catalog import METRIC_BOUNDS, METRICS
from driftwatch.operators import cleaning, rolling, rollup
from driftwatch.plans import views
from driftwatch.plans.registry import query
from driftwatch.plans.views import SEVEN, sql
from driftwatch.sources import tables
from driftwatch.storage import new_path, stage

NTZ = "timestamp_ntz"
RAW_SEVEN = SEVEN.replace("db_connections", "cast(db_connections as bigint) as db_connections")


def ntz(name):
    return F.col(name).cast(NTZ).alias(name)


def nested(ticks):
    """Wide ticks as nested payloads."""
    values = [F.col(m).cast("long").alias(m) if m == "db_connections" else F.col(m) for m in METRICS]
    return ticks.select("service_name", "host", "timestamp", F.struct(*values).alias("metrics"))


@query("S1 X4", sql(f'select "timestamp", service_name, host, {RAW_SEVEN} from ticks', "ticks"))
def payload_ingest(spark, sf):
    path = new_path(spark, "payloads")
    tables.append_json(nested(views.ticks(spark, sf)), path)
    ticks = cleaning.flatten_payload(tables.read_payloads(spark, path))
    return ticks.select(ntz("timestamp"), "service_name", "host", *METRICS)


@query("S1 X4", sql(f'select "timestamp", service_name, host, {RAW_SEVEN} from ticks', "ticks"))
def payload_messages(spark, sf):
    payload = F.to_json(F.struct("service_name", "host", "timestamp", "metrics"),
                        {"timestampFormat": tables.WRITTEN_TIMESTAMPS})
    messages = nested(views.ticks(spark, sf)).select(payload.alias("value"))
    ticks = cleaning.flatten_payload(tables.parse_payloads(messages))
    return ticks.select(ntz("timestamp"), "service_name", "host", *METRICS)


def _reason(m):
    low, high = METRIC_BOUNDS[m]
    above = "" if high is None else f" when {m} > {high} then '{m}: above {high}'"
    return f"case when {m} is null then '{m}: missing or mistyped' when {m} < {low} then '{m}: below {low}'{above} end"


REASONS_SQL = "concat_ws('; ', " + ", ".join(map(_reason, METRICS)) + ")"


@query("S2 T9", sql(f"""select event_id, reasons from (select event_id, {REASONS_SQL} as reasons from ticks)
                        where reasons <> ''""", "ticks"))
def payload_quarantine(spark, sf):
    _, bad = cleaning.validate(views.ticks(spark, sf))
    return bad.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@query("S2", sql(f"select event_id, {SEVEN} from ticks where {REASONS_SQL} = ''", "ticks"))
def payload_accepted(spark, sf):
    good, _ = cleaning.validate(views.ticks(spark, sf))
    return good.select("event_id", *METRICS)


@query("S3", sql("select event_id, metric_name, value from readings", "readings"))
def unpivot_readings(spark, sf):
    return views.readings(spark, sf).select("event_id", "metric_name", "value")


@query("S4 T7", sql("""select cast("timestamp" as date) as day, metric_name, count(*) as n,
                              round(sum(value), 6) as total from readings group by all""", "readings"))
def readings_sink(spark, sf):
    rows = views.readings(spark, sf)
    path = new_path(spark, "readings")
    tables.write_by_date(rows, path)
    stored = tables.read_by_date(spark, path, rows.schema)
    return stored.groupBy(F.col("date").alias("day"), "metric_name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


_NARROW = 'partition by service_name, metric_name order by "timestamp", event_id'


@query("S4 W1 W2 W4", sql(f"""select "timestamp", service_name, host, metric_name, value, rolling_avg, z_score, rate_of_change
    from (select *, {views.rolling_sql('value', '', _NARROW)} from readings)""", "readings"))
def enriched_readings_sink(spark, sf):
    """Every reading with its labels, stored by day and read back."""
    rows = rolling.narrow_features(views.readings(spark, sf), scale=views.SCALE).drop("event_id")
    path = new_path(spark, "enriched")
    tables.write_by_date(rows, path)
    stored = tables.read_by_date(spark, path, rows.schema)
    return stored.select(ntz("timestamp"), "service_name", "host", "metric_name", "value", "labels.*")


@query("S8", sql('select "timestamp", service_name, host, metric_name, value from readings', "readings"))
def full_history(spark, sf):
    return views.readings(spark, sf).select(ntz("timestamp"), "service_name", "host", "metric_name", "value")


@query("F1 F2", sql(f"select event_id, {SEVEN} from clean", "clean"))
def repair_ticks(spark, sf):
    return views.clean_ticks(spark, sf).select("event_id", *METRICS)


@query("F1 F2", sql("select event_id, metric_name, value from readings", "readings"))
def repair_readings(spark, sf):
    return cleaning.repair_narrow(cleaning.to_narrow(views.ticks(spark, sf))).select(
        "event_id", "metric_name", "value")


@query("F3", sql("select " + ", ".join(
    f"sum(case when t.{m} is distinct from c.{m} then 1 else 0 end)::bigint as {m}" for m in METRICS)
    + " from ticks t join clean c using (event_id)", "clean"))
def repair_flags(spark, sf):
    flagged = cleaning.repair(views.ticks(spark, sf), flags=True)
    return flagged.agg(*(F.count_if(f"{m}_repaired").alias(m) for m in METRICS))


@query("F4 F5 O1", sql("""select "timestamp", service_name, host, metric_name, value from readings
    where service_name = 'svc-3' and metric_name = 'cpu_usage' and "timestamp" >= timestamp '2024-01-05'
    order by "timestamp" desc limit 100""", "readings"))
def history_of_metric(spark, sf):
    found = cleaning.history(views.readings(spark, sf), "svc-3", "cpu_usage", from_time="2024-01-05")
    return found.select(ntz("timestamp"), "service_name", "host", "metric_name", "value")


@query("F4 O1", sql("""select "timestamp", service_name, metric_name, value from readings
    order by "timestamp" desc, service_name, metric_name limit 100""", "readings"))
def history_newest(spark, sf):
    found = cleaning.history(views.readings(spark, sf), "", None)
    return found.select(ntz("timestamp"), "service_name", "metric_name", "value")


@query("F6", sql("select event_id from ticks where " + " and ".join(f"{m} is not null" for m in METRICS), "ticks"))
def complete_ticks(spark, sf):
    return cleaning.complete_ticks(views.ticks(spark, sf)).select("event_id")


@query("A4", sql("select \"timestamp\", service_name, host, " + ", ".join(
    f"arg_min(value, event_id) filter (metric_name = '{m}') as {m}" for m in METRICS)
    + ' from readings group by "timestamp", service_name, host', "readings"))
def pivot_readings(spark, sf):
    wide = cleaning.to_wide(views.readings(spark, sf), ["timestamp", "service_name", "host"], "event_id")
    return wide.select(ntz("timestamp"), "service_name", "host", *METRICS)


# Short windows average 2, 4, 8 ... values, whose exact means end in a 5: nine places keep clear of rounding ties.
SHORT_SCALE = 9
_SUMMARY_SQL = """round(avg(value), 6) as avg_value, round(min(value), 6) as min_value,
                  round(max(value), 6) as max_value, count(value) as sample_count"""
_SHORT_SQL = _SUMMARY_SQL.replace(", 6)", ", 9)")


@query("A1", sql(f"""select service_name, metric_name, {_SUMMARY_SQL} from readings
    where "timestamp" between (select max(ts) from events) - interval 3 day and (select max(ts) from events)
    group by service_name, metric_name""", "readings"))
def trailing_summary(spark, sf):
    as_of = views.events(spark, sf).agg(F.max("ts")).first()[0]
    found = rollup.trailing_summary(views.readings(spark, sf), as_of, "3 days", views.SCALE)
    return found.drop("window_start", "window_end", "window_size")


def _windows(unit, summary=_SUMMARY_SQL):
    return sql(f"""select date_trunc('{unit}', "timestamp") as window_start, service_name, metric_name,
                          {summary} from readings group by all""", "readings")


def _window_query(spark, sf, length):
    found = rollup.window_summary_of_ticks(views.clean_ticks(spark, sf), length, SHORT_SCALE)
    return found.select(ntz("window_start"), "service_name", "metric_name", "avg_value", "min_value", "max_value",
                        "sample_count")


@query("A2", sql(f"""select time_bucket(interval '5 minutes', "timestamp") as window_start, service_name, metric_name,
                     {_SHORT_SQL} from readings group by all""", "readings"))
def five_minute_summary(spark, sf):
    return _window_query(spark, sf, "5 minutes")


@query("A3", _windows("hour", _SHORT_SQL))
def hourly_summary(spark, sf):
    return _window_query(spark, sf, "1 hour")


@query("A2", _windows("day"))
def daily_summary_of_readings(spark, sf):
    found = rollup.window_summary(views.readings(spark, sf), "1 day", views.SCALE)
    return found.select(ntz("window_start"), "service_name", "metric_name", "avg_value", "min_value", "max_value",
                        "sample_count")


@query("S6", _windows("day"))
def summary_sink(spark, sf):
    rows = rollup.window_summary_of_ticks(views.clean_ticks(spark, sf), "1 day", views.SCALE)
    path = new_path(spark, "summaries")
    tables.write_by_date(rows, path, "window_start")
    stored = tables.read_by_date(spark, path, rows.schema)
    return stored.select(ntz("window_start"), "service_name", "metric_name", "avg_value", "min_value", "max_value",
                         "sample_count")


@query("A5", sql("select distinct service_name, metric_name from readings", "readings"))
def service_metrics(spark, sf):
    return rollup.service_metrics(views.readings(spark, sf))


@query("A6", sql("select count(distinct service_name) as services, count(distinct host) as hosts from ticks", "ticks"))
def distinct_services(spark, sf):
    return views.ticks(spark, sf).agg(
        F.count_distinct("service_name").alias("services"), F.count_distinct("host").alias("hosts"))


@query("A6", sql("""select date_trunc('day', ts) as window_start, count(distinct user_id) as users, true as close from events group by 1"""))
def distinct_users_from_sketches(spark, sf):
    """Daily distinct users from hourly sketches, held against the exact count."""
    rows = views.events(spark, sf)
    sketches = stage(rollup.distinct_sketches(rows, "user_id", "1 hour", "ts"), "sketches")
    daily = rollup.distinct_estimates(sketches, "1 day")
    exact = rows.groupBy(F.window("ts", "1 day")["start"].alias("window_start")).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.06)
    return exact.join(daily, "window_start").select(ntz("window_start"), "users", near.alias("close"))


@query("A21", sql("""select service_name, count(*) as "rows", count(*) // 7 as samples, min("timestamp") as first_at,
                     max("timestamp") as last_at from readings group by service_name""", "readings"))
def load_audit(spark, sf):
    found = rollup.load_audit(views.readings(spark, sf))
    return found.select("service_name", "rows", "samples", ntz("first_at"), ntz("last_at"))


@query("A21", sql("select 0::bigint as null_labels"))
def null_labels(spark, sf):
    return rollup.null_labels(rolling.narrow_features(views.readings(spark, sf)))


@query("A21", sql("""select cast(hour("timestamp") as int) as hr, count(*) as readings from readings
                     where metric_name = 'requests_per_sec' group by 1""", "readings"))
def readings_per_hour(spark, sf):
    return rollup.readings_per_hour(views.readings(spark, sf))
