"""Where intermediate tables go: the shared folder that the session names."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from `spark.checkpoint.dir`.

    Only a local session without the setting gets a temporary folder; on a cluster the setting is required, since a
    folder of one machine would be lost with it.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="driftwatch-")
    return _local_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_folder(spark)}/driftwatch/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back, so that later passes neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
