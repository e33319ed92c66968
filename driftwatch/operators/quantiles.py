"""Exact order statistics of a column of any size, with only small counts on the driver."""

from collections import defaultdict
from math import floor, isfinite

from pyspark.sql import DataFrame, functions as F

BINS = 256


def _share(x, low, high):
    """Where x lies from low (0) to high (1), without overflow; rises with x."""
    if isinstance(low, int) and high - low < 1 << 53:
        return (x - F.lit(low)).cast("double") / F.lit(float(high - low))
    low, high, x = float(low), float(high), x.cast("double")
    if isfinite(high - low):
        return (x - F.lit(low)) / F.lit(high - low)
    return (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Value at each 0-based rank of the ascending, non-NULL `column`.

    Each pass counts the rows of the value ranges that still hold a wanted rank in BINS equal parts and goes on with the
    parts that hold it, until a part has one value. No sort, and at most len(ranks) * BINS rows reach the driver. Give a
    stored table: every pass reads the column again.
    """
    x = F.col(column)
    values = df.select(x.alias("x")).where(x.isNotNull())
    lowest, highest = values.agg(F.min("x"), F.max("x")).first()
    found: dict[int, float] = {}
    if lowest is None or not ranks:
        return found
    if not (isfinite(lowest) and isfinite(highest)):
        raise ValueError(f"{column} holds NaN or infinite values")
    # Open ranges: lowest value, highest value, rows below the range, ranks sought in it.
    todo = [(lowest, highest, 0, sorted(set(ranks)))]
    while todo:
        part = F.lit(None).cast("long")  # only rows inside a range reach its subtraction
        for i, (low, high, _, _) in enumerate(todo):
            if low < high:
                bin_no = F.least(F.floor(_share(F.col("x"), low, high) * BINS), F.lit(BINS - 1))
            else:
                bin_no = F.lit(0)
            part = F.when(F.col("x").between(low, high), bin_no + i * BINS).otherwise(part)
        counted = (
            values.select("x", part.alias("part")).where(F.col("part").isNotNull())
            .groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            .collect()
        )
        parts = defaultdict(list)
        for row in sorted(counted, key=lambda r: r["part"]):
            parts[row["part"] // BINS].append(row)
        narrower = []
        for i, (_, _, below, wanted) in enumerate(todo):
            for row in parts[i]:
                inside = [r for r in wanted if below <= r < below + row["n"]]
                if inside and row["low"] == row["high"]:
                    found |= dict.fromkeys(inside, row["low"])
                elif inside:
                    narrower.append((row["low"], row["high"], below, inside))
                below += row["n"]
        todo = narrower
    return found


def percentiles(df: DataFrame, column: str, percents: list[float]) -> list[float | None]:
    """Percentiles with linear interpolation between the two nearest ranks."""
    n = df.where(F.col(column).isNotNull()).count()
    if n == 0:
        return [None] * len(percents)
    places = [p / 100 * (n - 1) for p in percents]
    ranks = {floor(at) for at in places} | {min(floor(at) + 1, n - 1) for at in places}
    value = order_statistics(df, column, sorted(ranks))
    result = []
    for at in places:
        low, high = value[floor(at)], value[min(floor(at) + 1, n - 1)]
        result.append(low + (high - low) * (at - floor(at)))
    return result
