"""Continuous features and scores.

Every micro-batch runs the same windows as the batch job, on the new rows and the last few rows per key that the batches
before left in a keyed store. So both ways give the same values, a busy key is cut into chunks here as well, and a batch reads and
writes only the buckets of keys that it brings rows of. A restart goes on where the checkpoint says: a batch starts from the
store as it was before that batch, so a repeated batch still finds what the one before it left.

The watermark of a key is its newest time in earlier batches less a delay. A row that is not older may come in any order: it
is put in its place, and it and all rows after it are scored again. So a row may be scored in several batches, of which
the last one counts (`latest_scores`).
"""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from driftwatch.detectors.bundle import Bundle, score
from driftwatch.operators.rolling import REPLAY_LOOKBACK, add_features, add_trend
from driftwatch.operators.series import measure, series, stored, streak
from driftwatch.sources.keyed import BUCKETS, KeyedStore
from driftwatch.sources.tables import write_batch
from driftwatch.storage import stage

STREAK = "consecutive_anomalous_ticks"
DELAY = "10 minutes"  # of the watermark


def score_step(path: str, bundle: Bundle, keys=("service_name",), order=("timestamp", "event_id"), scale: int | None = 4,
               rows_per_chunk: int | None = None, delay: str = DELAY, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Micro-batch step: scored rows to `path/scored`, rows older than their key's watermark and repeated ones to `path/late`."""
    keys, order = list(keys), list(order)
    place = F.struct(*order)
    store = KeyedStore(f"{path}/state", tuple(keys), buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema] + [T.StructField(STREAK, T.LongType())])
        before, touched = store.touched(batch, schema, batch_id)
        present = batch.select(*keys).distinct()
        history = before.join(present, keys, "left_semi")
        newest = history.groupBy(*keys).agg(F.max(order[0]).alias("_newest"))
        known = history.select(*keys, *order, F.lit(True).alias("_known")).distinct()
        placed = batch.join(newest, keys, "left").join(known, [*keys, *order], "left")
        older = F.col(order[0]) < F.col("_newest") - F.expr(f"interval {delay}")
        late = F.coalesce(older, F.lit(False)) | F.col("_known").isNotNull()
        fresh = placed.where(~late).select(*batch.columns)
        write_batch(placed.where(late).select(*batch.columns), f"{path}/late", batch_id)

        # Scored are the new rows and all rows of their key behind the first of them.
        rows = fresh.withColumns({STREAK: F.lit(None).cast("long"), "_new": F.lit(True)})
        first = fresh.groupBy(*keys).agg(F.min(place).alias("_first"))
        old = history.join(first, keys, "left").withColumn("_new", F.coalesce(place > F.col("_first"), F.lit(False)))
        brought = old.where(place < F.col("_first")).groupBy(*keys).agg(F.max_by(STREAK, place).alias("_brought"))
        rows = rows.unionByName(old.drop("_first"))
        widths = measure(rows, keys, order[0], rows_per_chunk)
        s = add_features(series(rows.drop(STREAK), keys, order, REPLAY_LOOKBACK, widths=widths), scale=scale)
        s = add_trend(score(s, bundle, s.df.columns), "ensemble_score")
        s = stored(replace(s, df=s.df.where("_new")), "stream-scores")
        s = replace(s, df=s.df.join(brought, keys, "left"))
        s = streak(s, "ensemble_is_anomaly", STREAK, "_brought")
        write_batch(s.rows().drop("_new", "_brought"), f"{path}/scored", batch_id)

        # What the next batch needs: per key the rows that are not behind its watermark, the newest ones before, and their runs.
        ends = rows.groupBy(*keys).agg(F.max(order[0]).alias("_newest"))
        judged = rows.join(ends, keys, "left").withColumn(
            "_open", F.coalesce(F.col(order[0]) >= F.col("_newest") - F.expr(f"interval {delay}"), F.lit(False)))
        # By themselves, so that a task keeps the newest closed rows of what it reads, and a busy key is not sorted in one task.
        newest_first = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        closed = judged.where(~F.col("_open")).withColumn("_age", F.row_number().over(newest_first)).where(F.col("_age") <= REPLAY_LOOKBACK)
        kept = stage(judged.where("_open").unionByName(closed.drop("_age")), "stream-kept")
        scored = batch.sparkSession.read.parquet(f"{path}/scored/batch_id={batch_id}").join(kept, [*keys, *order], "left_semi").groupBy(
            *keys, *order).agg(F.max(STREAK).alias("_run"))
        kept = kept.join(scored, [*keys, *order], "left")
        kept = kept.withColumn(STREAK, F.when(F.col("_new"), F.col("_run")).otherwise(F.col(STREAK))).select(*schema.names)
        store.commit(kept.unionByName(before.join(present, keys, "left_anti")), touched, batch_id)
        batch.unpersist()
    return step


def latest_scores(spark: SparkSession, path: str, keys=("service_name",), order=("timestamp", "event_id")) -> DataFrame:
    """The rows of `path/scored`, each as the last batch that scored it left it."""
    last = Window.partitionBy(*keys, *order).orderBy(F.desc("batch_id"))
    return spark.read.parquet(f"{path}/scored").withColumn("_rank", F.rank().over(last)).where("_rank = 1").drop("_rank", "batch_id")


def start_scoring(ticks: DataFrame, path: str, checkpoint: str, bundle: Bundle, trigger: dict | None = None,
                  **options) -> StreamingQuery:
    """Score complete, clean ticks as they arrive."""
    return (
        ticks.writeStream.foreachBatch(score_step(path, bundle, **options)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
