"""Continuous summaries and closed alert intervals with watermarks."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from driftwatch.catalog import SUMMARY_WINDOW
from driftwatch.operators.rollup import window_summary_of_ticks
from driftwatch.sources.keyed import BUCKETS, KeyedStore, upsert
from driftwatch.sources.tables import write_batch

DELAY = "10 minutes"


def summary_stream(ticks: DataFrame, window: str = SUMMARY_WINDOW, delay: str = DELAY,
                   scale: int | None = 4) -> DataFrame:
    """Summaries of closed windows; later rows of a closed window are dropped."""
    return window_summary_of_ticks(ticks.withWatermark("timestamp", delay), window, scale)


def closed_intervals(anomalies: DataFrame, gap: str, delay: str = DELAY, keys=("service_name",)) -> DataFrame:
    """Intervals of anomalies that are at most `gap` apart, once no further row can join them."""
    grouped = anomalies.withWatermark("timestamp", delay).groupBy(
        F.session_window("timestamp", gap).alias("w"), *keys)
    return grouped.agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("last_seen_at"),
        F.count("*").alias("occurrence_count"),
    ).drop("w")


def start_append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", path).trigger(**(trigger or {"availableNow": True})).start()
    )


SUMMARY_KEYS = ("service_name", "metric_name", "window_start")


def summary_upserts(path: str, buckets: int = BUCKETS):
    """Micro-batch step for the changed summaries of an update-mode stream: the newest version of every window to `path/summaries`, and
    the versions that they replace to `path/retractions`.

    So open windows are stored as well and corrected while rows may still come; readers that have added up earlier versions subtract the
    retractions.
    """
    store = KeyedStore(f"{path}/summaries", SUMMARY_KEYS, buckets)

    def step(changed: DataFrame, batch_id: int) -> None:
        changed = changed.withColumn("version", F.lit(batch_id).cast("long")).persist()
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in changed.schema])
        before, _ = store.touched(changed, schema, batch_id)
        replaced = before.join(changed.select(*SUMMARY_KEYS), list(SUMMARY_KEYS), "left_semi")
        write_batch(replaced, f"{path}/retractions", batch_id)
        upsert(store, changed.to(schema), "version", batch_id)
        changed.unpersist()
    return step


def start_summary_upserts(ticks: DataFrame, path: str, checkpoint: str, window: str = SUMMARY_WINDOW, delay: str = DELAY,
                          scale: int | None = 4, trigger: dict | None = None) -> StreamingQuery:
    """Keep stored summaries of a stream of ticks up to date; rows may be late by `delay`."""
    return (
        summary_stream(ticks, window, delay, scale).writeStream.outputMode("update").foreachBatch(summary_upserts(path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def stored_summaries(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version of every window, the open ones included."""
    return KeyedStore(f"{path}/summaries", SUMMARY_KEYS).read(spark, schema)
