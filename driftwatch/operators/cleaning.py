"""Validation, repair and reshaping of metric readings."""

from pyspark.sql import Column, DataFrame, functions as F

from driftwatch.catalog import METRIC_BOUNDS, METRICS


def repaired(value: str, low, high) -> str:
    """SQL expression: NULL becomes the lower bound (0 without one); values are clipped to the bounds."""
    value = f"coalesce(double({value}), {low or 0}D)"
    if low is not None:
        value = f"greatest({value}, {low}D)"
    return value if high is None else f"least({value}, {high}D)"


def repair(ticks: DataFrame, flags: bool = False) -> DataFrame:
    """Repair the seven metric columns of wide ticks; `flags` adds `<metric>_repaired` booleans and their count."""
    columns = {m: F.expr(repaired(m, *METRIC_BOUNDS[m])) for m in METRICS}
    if flags:
        changed = {f"{m}_repaired": ~F.col(m).cast("double").eqNullSafe(columns[m]) for m in METRICS}
        ticks = ticks.withColumns(changed)
        ticks = ticks.withColumn("repaired_fields", sum((F.col(c).cast("int") for c in changed), F.lit(0)))
    return ticks.withColumns(columns)


def repair_narrow(readings: DataFrame) -> DataFrame:
    """Repair `value` of narrow readings; a metric outside the catalogue is only filled with 0."""
    value = F.coalesce("value", F.lit(0.0))
    for metric, (low, high) in METRIC_BOUNDS.items():
        value = F.when(F.col("metric_name") == metric, F.expr(repaired("value", low, high))).otherwise(value)
    return readings.withColumn("value", value)


def rejection_reasons(prefix: str = "") -> Column:
    """Array with one text per field that the input schema refuses."""
    reasons = []
    for metric, (low, high) in METRIC_BOUNDS.items():
        value = F.col(prefix + metric)
        reason = F.when(value.isNull() | F.isnan(value.cast("double")), f"{metric}: missing or mistyped")
        reason = reason.when(value < low, f"{metric}: below {low}")
        if high is not None:
            reason = reason.when(value > high, f"{metric}: above {high}")
        reasons.append(reason)
    for field in ("service_name", "host", "timestamp"):
        reasons.append(F.when(F.col(field).isNull(), f"{field}: missing or mistyped"))
    return F.array_compact(F.array(*reasons))


def validate(ticks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); one bad field rejects the whole payload, and `reasons` tells which."""
    judged = ticks.withColumn("reasons", rejection_reasons())
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def flatten_payload(payloads: DataFrame) -> DataFrame:
    """Nested payload -> wide tick."""
    others = [c for c in payloads.columns if c != "metrics"]
    return payloads.select(*others, *(F.col(f"metrics.{m}").alias(m) for m in METRICS))


def to_narrow(ticks: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row per metric and tick: columns metric_name, value."""
    others = [c for c in ticks.columns if c not in metrics]
    return ticks.withColumns({m: F.col(m).cast("double") for m in metrics}).unpivot(
        others, metrics, "metric_name", "value")


def to_wide(readings: DataFrame, index: list[str], ingest_order: str, metrics: list[str] = METRICS) -> DataFrame:
    """One row per index with a column per metric: the earliest ingested non-NULL value.

    Conditional aggregates combine on the map side, so repeated readings of one tick shrink before the shuffle.
    """
    def first(metric):
        wanted = (F.col("metric_name") == metric) & F.col("value").isNotNull()
        return F.min_by(F.when(wanted, F.col("value")), F.when(wanted, F.col(ingest_order))).alias(metric)
    return readings.groupBy(*index).agg(*(first(m) for m in metrics))


def complete_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks on which all seven metrics are present."""
    return ticks.where(" AND ".join(f"{m} IS NOT NULL" for m in METRICS))


def history(readings: DataFrame, service_name=None, metric_name=None, from_time=None, to_time=None,
            limit: int = 100) -> DataFrame:
    """The newest `limit` readings that pass the given filters; an empty filter counts as absent."""
    if service_name:
        readings = readings.where(F.col("service_name") == service_name)
    if metric_name:
        readings = readings.where(F.col("metric_name") == metric_name)
    readings = between(readings, F.lit(from_time).cast("timestamp") if from_time else None,
                       F.lit(to_time).cast("timestamp") if to_time else None)
    shown = readings.drop("labels", "ingested_at")
    ties = [c for c in ("host", "event_id", "value") if c in shown.columns]
    return shown.orderBy(F.desc("timestamp"), "service_name", "metric_name", *ties).limit(limit)


def between(readings: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    """Readings from `start` to `end`, both included; days that a table stored by date keeps apart are not opened."""
    dated = "date" in readings.columns
    if start is not None:
        readings = readings.where(F.col("timestamp") >= start)
        readings = readings.where(F.col("date") >= F.to_date(start)) if dated else readings
    if end is not None:
        readings = readings.where(F.col("timestamp") <= end)
        readings = readings.where(F.col("date") <= F.to_date(end)) if dated else readings
    return readings


def require_rows(df: DataFrame, what: str = "readings") -> DataFrame:
    """Fail early on empty input."""
    if df.isEmpty():
        raise ValueError(f"no {what}: load data before running this job")
    return df
