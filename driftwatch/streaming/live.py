"""From payloads to explained alerts: intake, scores, explanation and the alert life cycle in one job.

Every micro-batch passes two stateful stages, which hand over by batch: the scoring step writes the batch's scores, and the alert step reads just
these. Both start from what the batch before left and replace what a failed attempt wrote, so a row counts once however often a batch is
repeated.

A row may be scored again as long as its service's watermark has not passed it. The alert step therefore keeps the anomalous readings that are
still open one by one, and replaces those that the batch scored again; readings behind the watermark are final and only live on in
intervals (start, end, count, severity, newest reading), which merge in any order. Readings shrink to such intervals by partial aggregation, so
a busy fingerprint is reduced where its rows are read. Intervals that nothing can join any more leave the state.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from driftwatch.catalog import RESOLVE_AFTER_SECONDS
from driftwatch.detectors.bundle import Bundle
from driftwatch.escalation.explain import Leaves, explain_leaves
from driftwatch.functions.columns import fingerprint, severity_rank
from driftwatch.operators.alerting import SNAPSHOT, alert_rows, finish_alerts
from driftwatch.sources.keyed import BUCKETS, KeyedStore
from driftwatch.sources.tables import write_batch
from driftwatch.streaming.ingest import take_in
from driftwatch.streaming.scoring import DELAY, score_step

ORDER = ("timestamp", "host")
CLOCK, FINAL, OPEN = 0, 1, 2
KEYS = ["fingerprint", "service_name"]


def as_intervals(candidates: DataFrame, order) -> DataFrame:
    """Alert candidates as intervals of one reading."""
    rank = severity_rank(F.col("severity")).cast("int")
    return candidates.select(
        *KEYS, F.col("timestamp").alias("started_at"), F.col("timestamp").alias("last_seen_at"), F.lit(1).cast("long").alias("occurrence_count"),
        rank.alias("severity_rank"), F.struct(*dict.fromkeys([*order, *SNAPSHOT])).alias("latest"))


def merged(intervals: DataFrame, gap: int, order) -> DataFrame:
    """Join intervals of a fingerprint that are at most `gap` microseconds apart.

    Intervals that start within the same `gap` always belong together, so they shrink by partial aggregates to one for each such cell of time
    before the cells of a fingerprint meet.
    """
    newest = F.max_by("latest", F.struct(*(F.col(f"latest.{c}") for c in order)))
    sums = [F.min("started_at").alias("started_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("occurrence_count").alias("occurrence_count"),
            F.max("severity_rank").alias("severity_rank"), newest.alias("latest")]
    cells = intervals.groupBy(*KEYS, F.floor(F.unix_micros("started_at") / F.lit(max(gap, 1))).alias("_cell")).agg(*sums).drop("_cell")
    before = Window.partitionBy(*KEYS).orderBy("started_at")
    end = F.max("last_seen_at").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = end.isNull() | (F.unix_micros("started_at") - F.unix_micros(end) > gap)
    numbered = cells.withColumn("_opens", opens.cast("long")).withColumn("_no", F.sum("_opens").over(before))
    return numbered.groupBy(*KEYS, "_no").agg(*sums).drop("_no")


def alert_step(path: str, gap_seconds: float = RESOLVE_AFTER_SECONDS, delay: str = DELAY, order=ORDER, buckets: int = BUCKETS):
    """Micro-batch step: the scored rows of a batch into the alerts below `path/alerts`; `delay` is that of the scoring step."""
    gap, order = int(gap_seconds * 1_000_000), list(order)
    store = KeyedStore(f"{path}/alerts/state", ("fingerprint",), buckets)

    def step(scored: DataFrame, batch_id: int) -> None:
        fresh = as_intervals(alert_rows(scored), order).withColumn("kind", F.lit(OPEN))
        seen = scored.groupBy(fingerprint(F.col("service_name")).alias("fingerprint"), "service_name").agg(
            F.min(F.struct(*order)).alias("_first"), F.max("timestamp").alias("_newest"))
        before, touched = store.touched(seen, _nullable(fresh.schema), batch_id)
        clocks = (
            seen.join(before.where(f"kind = {CLOCK}").select(*KEYS, F.col("last_seen_at").alias("_clock")), KEYS, "full")
            .select(*KEYS, "_first", F.greatest("_newest", "_clock").alias("_newest"))
            .withColumn("_watermark", F.col("_newest") - F.expr(f"interval {delay}")))
        # what is scored again replaces what was known of it
        again = F.struct(*(F.col(f"latest.{c}").alias(c) for c in order)) >= F.col("_first")
        kept = before.where(f"kind <> {CLOCK}").join(clocks, KEYS).where((F.col("kind") == FINAL) | ~F.coalesce(again, F.lit(False)))
        rows = kept.drop("_first").unionByName(fresh.join(clocks.drop("_first"), KEYS))
        settled = (F.col("kind") == FINAL) | (F.col("started_at") < F.col("_watermark"))
        rows = rows.withColumn("_settled", settled).persist()
        intervals = merged(rows.where("_settled"), gap, order).join(clocks.select(*KEYS, "_watermark"), KEYS)
        done = F.unix_micros("last_seen_at") + gap < F.unix_micros("_watermark")
        names = fresh.columns
        write_batch(intervals.where(done).withColumn("kind", F.lit(FINAL)).select(*names), f"{path}/alerts/closed", batch_id)
        none = {c: F.lit(None).cast(fresh.schema[c].dataType) for c in ("occurrence_count", "severity_rank", "latest")}
        times = clocks.select(*KEYS, F.col("_newest").alias("started_at"), F.col("_newest").alias("last_seen_at"), F.lit(CLOCK).alias("kind"))
        left = (intervals.where(~done).withColumn("kind", F.lit(FINAL)).select(*names).unionByName(rows.where("not _settled").select(*names))
                .unionByName(times.withColumns(none).select(*names)))
        store.commit(left, touched, batch_id)
        rows.unpersist()
    return step


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def stored_alerts(spark: SparkSession, path: str, gap_seconds: float = RESOLVE_AFTER_SECONDS, as_of=None, order=ORDER) -> DataFrame:
    """The alerts as the newest committed batch left them, in the form of `alerting.alerts`."""
    store = KeyedStore(f"{path}/alerts/state", ("fingerprint",))
    try:
        closed = spark.read.parquet(f"{path}/alerts/closed")
    except AnalysisException as error:
        raise ValueError(f"{path}: no batch has been taken in") from error
    schema = T.StructType([f for f in closed.schema if f.name != "batch_id"])
    live = store.read(spark, schema).where(f"kind <> {CLOCK}").drop("kind")
    # files of a batch that was not committed do not count
    closed = closed.where(F.col("batch_id") <= F.lit(store.batch(spark))).drop("batch_id", "kind")
    found = merged(live, int(gap_seconds * 1_000_000), list(order)).unionByName(closed)
    shown = [c for c in SNAPSHOT if c not in KEYS]
    return finish_alerts(found.select(*KEYS, "started_at", "last_seen_at", "occurrence_count", "severity_rank",
                                      *(F.col(f"latest.{c}").alias(c) for c in shown)), gap_seconds, as_of)


def live_step(path: str, bundle: Bundle, escalation: Leaves | None = None, gap_seconds: float = RESOLVE_AFTER_SECONDS, delay: str = DELAY,
              on_invalid: str = "reject", order=ORDER, buckets: int = BUCKETS, **options):
    """Micro-batch step for payloads: `path/ticks`, `path/quarantine`, `path/scored`, `path/late` and `path/alerts`.

    A tick is known by its service and `order`; the same tick once more goes to `late/`. Without `escalation`, alerts have neither probability nor sentence,
    and their severity comes from the votes.
    """
    intake = take_in(path, on_invalid)
    scoring = score_step(path, bundle, order=order, delay=delay, **options)
    alerting = alert_step(path, gap_seconds, delay, order, buckets)

    def step(payloads: DataFrame, batch_id: int) -> None:
        spark = payloads.sparkSession
        intake(payloads, batch_id)
        scoring(spark.read.parquet(f"{path}/ticks/batch_id={batch_id}"), batch_id)
        scored = spark.read.parquet(f"{path}/scored/batch_id={batch_id}")
        alerting(explain_leaves(scored, escalation) if escalation else scored, batch_id)
    return step


def start_live(payloads: DataFrame, path: str, checkpoint: str, bundle: Bundle, escalation: Leaves | None = None, trigger: dict | None = None,
               **options) -> StreamingQuery:
    """Alerts from a stream of payloads."""
    return (
        payloads.writeStream.foreachBatch(live_step(path, bundle, escalation, **options)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
