"""Stored training sets: scaled features, sequences, labels and splits, with a manifest of what they were made with."""

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwatch.catalog import FEATURES, SEQUENCE_ROWS
from driftwatch.operators.rolling import ORDER, check_feature_order, sequences, stretches
from driftwatch.operators.scaling import Scaler
from driftwatch.operators.series import Widths, series

MANIFEST = "features array<string>, sequence_length int, scaler_sha256 string"
LEARNT = ["features", "sequence", "label"]


def scaler_digest(scaler: Scaler) -> str:
    """The same for scalers with the same columns in the same order and the same numbers."""
    parts = zip(scaler.columns, scaler.means, scaler.stds)
    return hashlib.sha256("\n".join(f"{c} {m!r} {s!r}" for c, m, s in parts).encode()).hexdigest()


def write_training_set(rows: DataFrame, path: str, scaler: Scaler, label: str = "is_anomaly", split: str = "split", keys=("service_name",),
                       order=tuple(ORDER), length: int = SEQUENCE_ROWS, widths: Widths | None = None) -> None:
    """Write labelled feature rows as keys, order, features (28 scaled numbers), sequence (the last `length` of them; NULL while there are fewer)
    and label (0 or 1), in a folder for each split.

    Features and sequences are stored as `stretches`, which take hardly more room than the features alone; reading gives the rows back.
    Sequences come from chunked series, so a busy service is not one task. The manifest is written last: without it the set does not count.
    """
    check_feature_order(FEATURES, list(scaler.columns))
    spark = rows.sparkSession
    shown = list(dict.fromkeys([*keys, *order]))
    narrow = rows.select(*dict.fromkeys([split, *shown]), F.col(label).cast("int").alias("label"), scaler.vector().alias("features"))
    s = series(narrow, list(keys), list(order), length - 1, widths=widths)
    made = stretches(s, "features", list(dict.fromkeys([split, *shown, "label"])), length)
    # A stretch that reaches over splits is stored with each of them, where the rows of the others count as copies.
    splits = F.array_distinct(F.transform(F.filter("rows", lambda r: ~r["copy"]), lambda r: r[split]))
    each = made.select("rows", "vectors", F.explode(splits).alias("_split"))
    own = F.transform("rows", lambda r: F.struct(
        (r["copy"] | ~r[split].eqNullSafe(F.col("_split"))).alias("copy"), *(r[c].alias(c) for c in [*shown, "label"] if c != split)))
    out = each.select(F.col("_split").alias(split), own.alias("rows"), "vectors")
    out.hint("rebalance", F.col(split)).write.mode("overwrite").partitionBy(split).parquet(f"{path}/rows")
    manifest = [(list(scaler.columns), length, scaler_digest(scaler))]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_training_set(spark: SparkSession, path: str, features: list[str] = FEATURES, scaler: Scaler | None = None) -> DataFrame:
    """The rows of a training set; refused when its features, or its scaler if one is given, are not those expected."""
    try:
        made = spark.read.parquet(f"{path}/manifest").first()
    except AnalysisException as error:
        raise ValueError(f"{path}: no complete training set") from error
    check_feature_order(features, made["features"])
    if scaler is not None and scaler_digest(scaler) != made["scaler_sha256"]:
        raise ValueError(f"{path}: made with another scaler")
    rows = sequences(spark.read.parquet(f"{path}/rows"), "sequence", made["sequence_length"], "features")
    return rows.select(*(c for c in rows.columns if c not in LEARNT), *LEARNT)
