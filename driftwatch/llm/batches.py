"""Arrow batches inside tasks, a few rows at a time."""

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 200  # of a batch that are turned into Python objects at once


def slices(batches, rows=ROWS):
    """All rows of the batches in slices, so that a worker holds the texts of a slice beside a batch, not those of the whole batch again."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def chosen(batches, at, choose):
    """The rows whose texts (column number `at`) `choose`, from a list of texts to one of booleans, takes; all columns as they are."""
    for part in slices(batches):
        yield part.filter(pa.array(choose(part.column(at).cast(pa.string()).to_pylist()), pa.bool_()))


@contextmanager
def at_most(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for what runs meanwhile, where rows are large: the JVM and the worker both hold a whole batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
