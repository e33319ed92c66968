"""Bounded attempts for micro-batch steps, and a place for batches that never pass."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwatch.sources.tables import write_batch

ATTEMPTS, DELAY_SECONDS = 3, 5.0
ERROR_LENGTH = 4000


def retrying(step: Callable[[DataFrame, int], None], path: str, attempts: int = ATTEMPTS, delay_seconds: float = DELAY_SECONDS,
             sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A step that runs `step` up to `attempts` times, waiting longer each time; then the batch's rows go to `path/dead` with the error, and
    the query goes on.

    Steps replace what an earlier attempt of the same batch wrote, so an attempt that got half way does no harm. A stop of the query is passed on.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return step(batch, batch_id)
            except Exception as error:
                if attempt < attempts:
                    sleep(delay_seconds * 2 ** (attempt - 1))
                    continue
                text = f"{type(error).__name__}: {error}"[:ERROR_LENGTH]
                write_batch(batch.withColumns({"error": F.lit(text), "attempts": F.lit(attempts)}), f"{path}/dead", batch_id)
    return run


def set_aside(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The rows of a batch that was set aside, without error and attempts, to be given to a mended step."""
    return spark.read.parquet(f"{path}/dead/batch_id={batch_id}").drop("error", "attempts")
