"""A keyed table that micro-batches change: hash buckets, copied when they are written, and a manifest for each batch.

A batch writes the new contents of the buckets that it touches beside the old ones and then one small manifest, which says for every
bucket which batch wrote it last. Only the manifest makes the files count. So a batch that fails leaves nothing behind that is read, a
repeated batch starts from the manifest before it and writes the same again, and a bucket that no row of the batch falls into is neither
read nor written. Old versions of buckets stay until the folder expires.
"""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64
BUCKET, VERSION = "_bucket", "_version"
MANIFEST = f"batch_id long, {BUCKET} int, {VERSION} long"


@dataclass(frozen=True)
class KeyedStore:
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _slots(self, spark: SparkSession) -> dict[int, tuple[int, dict[int, int]]]:
        """Slot -> (batch, version by bucket) of the two newest manifests, each of at most `buckets` rows."""
        found = {}
        for slot in (0, 1):
            try:
                rows = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{slot}").collect()
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                rows = []
            if rows:  # an overwritten slot whose writing failed is empty; the other one then holds the manifest that counts
                found[slot] = rows[0]["batch_id"], {r[BUCKET]: r[VERSION] for r in rows if r[BUCKET] is not None}
        return found

    def _before(self, spark: SparkSession, batch_id: int | None) -> tuple[int | None, int | None, dict[int, int]]:
        """(slot, batch, versions) of the newest manifest, or the newest before `batch_id`."""
        known = [(batch, slot, versions) for slot, (batch, versions) in self._slots(spark).items() if batch_id is None or batch < batch_id]
        if not known:
            return None, None, {}
        batch, slot, versions = max(known, key=lambda k: k[0])
        return slot, batch, versions

    def batch(self, spark: SparkSession) -> int | None:
        """The newest batch that is committed."""
        return self._before(spark, None)[1]

    def _rows(self, spark: SparkSession, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """All rows as the newest committed batch left them."""
        return self._rows(spark, schema, self._before(spark, None)[2])

    def touched(self, changes: DataFrame, schema: T.StructType, batch_id: int) -> tuple[DataFrame, list[int]]:
        """(the rows before `batch_id` in the buckets that `changes` falls into, these buckets)."""
        buckets = [r[0] for r in changes.select(self.bucket()).distinct().collect()]
        versions = self._before(changes.sparkSession, batch_id)[2]
        return self._rows(changes.sparkSession, schema, {b: v for b, v in versions.items() if b in buckets}), buckets

    def commit(self, rows: DataFrame, buckets: list[int], batch_id: int) -> None:
        """Make `rows` the whole contents of `buckets`. The rows of a bucket become few files; a large bucket is split by the adaptive planner."""
        spark = rows.sparkSession
        slot, _, versions = self._before(spark, batch_id)
        versions = {b: v for b, v in versions.items() if b not in buckets}
        data = f"{self.path}/data/{VERSION}={batch_id}"
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        written = spark.read.schema(f"{BUCKET} int").option("basePath", data).parquet(data).select(BUCKET).distinct()
        versions |= {r[0]: batch_id for r in written.collect()}
        manifest = [(batch_id, b, v) for b, v in sorted(versions.items())] or [(batch_id, None, None)]
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{0 if slot == 1 else 1}")


def upsert(store: KeyedStore, changes: DataFrame, version: str, batch_id: int) -> None:
    """Keep the row with the largest `version` of every key; a change that is told again changes nothing."""
    before, buckets = store.touched(changes, changes.schema, batch_id)
    newest = F.max_by(F.struct(*changes.columns), F.col(version)).alias("r")
    store.commit(before.unionByName(changes).groupBy(*store.keys).agg(newest).select("r.*"), buckets, batch_id)
