"""Readers and writers."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from driftwatch.catalog import PAYLOAD, TRUTH

TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"
WRITTEN_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
CORRUPT = T.StructField("_corrupt_record", T.StringType())


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, CORRUPT])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of nested payloads; a line that does not fit the schema keeps its text in `_corrupt_record`."""
    return spark.read.schema(with_corrupt(PAYLOAD)).option("timestampFormat", TIMESTAMPS).json(path)


def read_payload_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same as a stream over a folder; the batch size bounds what a stateful step sees at once."""
    return (
        spark.readStream.schema(with_corrupt(PAYLOAD)).option("timestampFormat", TIMESTAMPS)
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def parse_payloads(messages: DataFrame, value: str = "value") -> DataFrame:
    """Payloads from a message column (for instance a Kafka value)."""
    options = {"timestampFormat": TIMESTAMPS, "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(F.col(value).cast("string"), with_corrupt(PAYLOAD), options)
    return messages.withColumn("_p", parsed).select("_p.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labels."""
    return spark.read.schema(with_corrupt(TRUTH)).option("timestampFormat", TIMESTAMPS).json(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("timestampFormat", WRITTEN_TIMESTAMPS).json(path)


def write_by_date(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Parquet partitioned by day. The rows of a day are brought together first, so that it gets few files; a day with
    many rows is split again by the adaptive planner."""
    dated = df.withColumn("date", F.to_date(ts))
    dated.hint("rebalance", F.col("date")).write.mode(mode).partitionBy("date").parquet(path)


def read_by_date(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    dated = T.StructType([*schema.fields, T.StructField("date", T.DateType())])
    return spark.read.schema(dated).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder; a repeated batch replaces it, so nothing is stored twice."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
