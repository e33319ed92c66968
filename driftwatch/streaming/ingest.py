"""Continuous intake of payloads."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwatch.operators.cleaning import flatten_payload, repair, validate
from driftwatch.sources.tables import write_batch


def take_in(path: str, on_invalid: str = "reject"):
    """Micro-batch step: accepted ticks to `path/ticks`, refused payloads with their reasons to `path/quarantine`.

    `on_invalid="repair"` fills and clips bad values instead; then only unreadable payloads are refused.
    """
    if on_invalid not in ("reject", "repair"):
        raise ValueError("on_invalid must be 'reject' or 'repair'")

    def step(batch: DataFrame, batch_id: int) -> None:
        ticks = flatten_payload(batch)
        if on_invalid == "reject":
            good, bad = validate(ticks)
        else:
            unreadable = F.col("timestamp").isNull() | F.col("service_name").isNull()
            good = repair(ticks.where(~unreadable))
            bad = ticks.where(unreadable).withColumn("reasons", F.array(F.lit("unreadable")))
        write_batch(good.drop("_corrupt_record"), f"{path}/ticks", batch_id)
        write_batch(bad, f"{path}/quarantine", batch_id)
    return step


def start_intake(payloads: DataFrame, path: str, checkpoint: str, on_invalid: str = "reject",
                 trigger: dict | None = None) -> StreamingQuery:
    return (
        payloads.writeStream.foreachBatch(take_in(path, on_invalid)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
