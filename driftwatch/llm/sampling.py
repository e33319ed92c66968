"""Folds and bounded samples by hash, the same whenever a task is repeated."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from learning: crc32 of the key's text has remainder 1 by 3. A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, or all if it has fewer, chosen by a hash of the key."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
