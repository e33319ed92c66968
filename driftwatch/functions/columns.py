"""Scalar column expressions; all stay inside the JVM."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwatch.catalog import (
    INTENSITY_MILD_BELOW,
    INTENSITY_MODERATE_BELOW,
    LOAD_FLOOR,
    LOAD_PEAK_HOUR,
    OFF_HOURS_BELOW,
    SEVERITIES,
    SEVERITY_BY_PROBABILITY,
)

MICROS = 1_000_000


def rounded(x: Column, scale: int | None) -> Column:
    return x if scale is None else F.round(x, scale)


def nearest_second(ts: Column) -> Column:
    """Timestamp rounded to the nearest second, halves to the even second."""
    micros = F.unix_micros(ts)
    rest = F.pmod(micros, F.lit(MICROS))
    second = ((micros - rest) / MICROS).cast("long")
    up = (rest > MICROS // 2) | ((rest == MICROS // 2) & (F.pmod(second, F.lit(2)) == 1))
    return F.timestamp_seconds(second + up.cast("long"))


def hour_of_day(ts: Column) -> Column:
    """Fractional UTC hour."""
    return F.hour(ts) + F.minute(ts) / 60.0


def hour_sin(ts: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * hour_of_day(ts) / 24.0)


def hour_cos(ts: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * hour_of_day(ts) / 24.0)


def load_factor(ts: Column) -> Column:
    """Expected traffic by time of day: 1.0 at 14:00 UTC, 0.3 at 02:00 UTC."""
    wave = 0.5 + 0.5 * F.cos(F.lit(2.0) * F.pi() * (hour_of_day(ts) - LOAD_PEAK_HOUR) / 24.0)
    return F.least(F.greatest(LOAD_FLOOR + (1.0 - LOAD_FLOOR) * wave, F.lit(LOAD_FLOOR)), F.lit(1.0))


def off_hours(ts: Column) -> Column:
    return load_factor(ts) < OFF_HOURS_BELOW


def severity_of_intensity(intensity: Column) -> Column:
    return (
        F.when(intensity < INTENSITY_MILD_BELOW, "mild")
        .when(intensity < INTENSITY_MODERATE_BELOW, "moderate")
        .when(intensity.isNotNull(), "severe")
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def percent_text(p: Column) -> Column:
    return F.format_string("%.0f%%", p * 100.0)


def fingerprint(service: Column) -> Column:
    """The identity of a problem: one per service."""
    return F.concat(F.lit("multivariate:"), service)


def metric_of_feature(feature: Column) -> Column:
    """`cpu_usage_z_score` -> `cpu_usage`."""
    return F.regexp_replace(feature, "_(rolling_avg|z_score|rate_of_change)$", "")


def largest_magnitude(*columns: Column) -> Column:
    return F.array_max(F.array(*(F.abs(c) for c in columns)))


def mean_squared_difference(left: Column, right: Column) -> Column:
    """Mean squared difference of two equally long arrays."""
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(left)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.when(whole != 0, whole))


def votes_needed(available: Column) -> Column:
    return F.floor(available / 2).cast("int") + 1


def vote(flags: list[Column], values: list[Column]) -> tuple[Column, Column, Column, Column]:
    """(votes, available, score, is_anomaly): majority of the detectors that gave a value.

    With no detector available the reading passes as normal with score 0.
    """
    available = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    votes = sum(((v.isNotNull() & F.coalesce(f, F.lit(False))).cast("int") for f, v in zip(flags, values)), F.lit(0))
    score = F.round(ratio(votes.cast("double"), available.cast("double")), 4)
    return votes, available, score, (available > 0) & (votes >= votes_needed(available))


def alert_severity(probability: Column, votes: Column, available: Column) -> Column:
    """Severity by escalation probability; without one, unanimous detectors are critical."""
    by_probability = (
        F.when(probability >= SEVERITY_BY_PROBABILITY["CRITICAL"], "CRITICAL")
        .when(probability >= SEVERITY_BY_PROBABILITY["WARNING"], "WARNING")
        .otherwise("INFO")
    )
    by_votes = F.when((available > 0) & (votes == available), "CRITICAL").otherwise("WARNING")
    return F.when(probability.isNotNull(), by_probability).otherwise(by_votes)


def severity_rank(severity: Column) -> Column:
    """INFO 0 < WARNING 1 < CRITICAL 2."""
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def register_sql(spark: SparkSession) -> None:
    """Make the main expressions callable from SQL as session functions."""
    definitions = {
        "nearest_second(ts TIMESTAMP) RETURNS TIMESTAMP":
            "timestamp_seconds(CAST(bround(CAST(unix_micros(ts) AS DECIMAL(20,0)) / 1000000, 0) AS BIGINT))",
        "load_factor(ts TIMESTAMP) RETURNS DOUBLE":
            "least(greatest(0.3D + 0.7D * (0.5D + 0.5D * cos(2D * pi() * (hour(ts) + minute(ts) / 60D - 14D) / 24D)),"
            " 0.3D), 1.0D)",
        "ensemble_is_anomaly(votes INT, available INT) RETURNS BOOLEAN":
            "available > 0 AND votes >= available DIV 2 + 1",
        "alert_severity(probability DOUBLE, votes INT, available INT) RETURNS STRING":
            "CASE WHEN probability >= 0.5D THEN 'CRITICAL' WHEN probability >= 0.2D THEN 'WARNING'"
            " WHEN probability IS NOT NULL THEN 'INFO'"
            " WHEN available > 0 AND votes = available THEN 'CRITICAL' ELSE 'WARNING' END",
    }
    for signature, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def with_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour of day, its cyclic encoding, the load factor and the off-hours flag."""
    t = F.col(ts)
    return df.withColumns({
        "hour_utc": hour_of_day(t),
        "hour_sin": hour_sin(t),
        "hour_cos": hour_cos(t),
        "tod_factor": load_factor(t),
        "is_off_hours": off_hours(t),
    })
