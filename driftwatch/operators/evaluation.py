"""Data checks, threshold sweeps and detection quality."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwatch.catalog import FOREST_GRID_POINTS, SEQUENCE_GRID, Z_SCORES
from driftwatch.functions.columns import metric_of_feature, ratio
from driftwatch.operators.quantiles import percentiles


def class_balance(df: DataFrame, label: str = "is_anomaly", by: str = "split") -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(by).agg(
        F.count("*").alias("rows"), F.sum(y).alias("positives"), F.avg(y.cast("double")).alias("rate"))


def broken_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL, NaN and infinite values per column, from one aggregate over all columns."""
    def counts(c):
        x = F.col(c).cast("double")
        return F.struct(
            F.count_if(x.isNull()).alias("nulls"),
            F.count_if(F.isnan(x)).alias("nans"),
            F.count_if(F.abs(x) == float("inf")).alias("infs"),
        ).alias(c)
    row = df.agg(*(counts(c) for c in columns))
    return row.unpivot([], columns, "feature", "c").select("feature", "c.*")


def column_profile(df: DataFrame, columns: list[str], scale: int | None = None) -> DataFrame:
    """Mean and population standard deviation per column.

    With `scale`, the mean comes from an exact sum of the values at that many places, whatever the order of the rows.
    """
    def mean(c):
        if scale is None:
            return F.avg(c)
        return F.sum(F.col(c).cast(f"decimal(28,{scale})")).cast("double") / F.count(c)
    row = df.agg(*(F.struct(mean(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "s").select("feature", "s.*")


def class_histogram(df: DataFrame, column: str, label: str = "is_anomaly", bins: int = 50) -> DataFrame:
    """Density histogram of each class over its own range; the last bin includes the maximum."""
    x = F.col(column)
    df = df.withColumn(label, F.col(label).cast("boolean"))
    # A boolean has at most three values, so the range table has at most three rows.
    ranges = df.groupBy(label).agg(
        F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.when(width > 0, F.least(F.floor((x - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return (
        df.where(x.isNotNull()).join(F.broadcast(ranges), label)
        .groupBy(label, place.cast("int").alias("bin"), "low", "high", "n").agg(F.count("*").alias("rows"))
        .select(label, "bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), "rows",
                ratio(F.col("rows").cast("double"), F.col("n") * width).alias("density"))
    )


def worst_z(columns: list[str] = Z_SCORES) -> Column:
    """Largest |z| of a row."""
    return F.array_max(F.array(*(F.abs(c) for c in columns)))


def worst_metric(columns: list[str] = Z_SCORES) -> Column:
    """Name of the metric with the largest |z|; the first one wins ties."""
    sizes = F.array(*(F.abs(c) for c in columns))
    names = F.array(*(F.lit(c) for c in columns))
    return metric_of_feature(F.element_at(names, F.array_position(sizes, F.array_max(sizes)).cast("int")))


def worst_metric_frequency(df: DataFrame) -> DataFrame:
    return df.groupBy(worst_metric().alias("metric")).agg(F.count("*").alias("rows")).orderBy(
        F.desc("rows"), "metric")


def z_summary(df: DataFrame, limit: float = 5.75) -> DataFrame:
    """Range and mean of all z-scores and of the worst |z| per row, with the share of rows above `limit`."""
    worst = worst_z()
    return df.agg(
        F.min(F.least(*Z_SCORES)).alias("z_min"),
        F.max(F.greatest(*Z_SCORES)).alias("z_max"),
        (sum((F.sum(c) for c in Z_SCORES), F.lit(0.0)) / (F.count("*") * len(Z_SCORES))).alias("z_mean"),
        F.min(worst).alias("worst_min"),
        F.max(worst).alias("worst_max"),
        F.avg(worst).alias("worst_mean"),
        F.avg((worst > limit).cast("double")).alias("share_above"),
    )


def z_median(df: DataFrame) -> float:
    """Exact median of |z| over all rows and metrics. Reads `df` several times: give a stored table."""
    z = df.select(F.explode(F.array(*(F.abs(c) for c in Z_SCORES))).alias("z"))
    return percentiles(z, "z", [50.0])[0]


def step_grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... below stop."""
    return [start + i * step for i in range(round((stop - start) / step))]


def linear_grid(df: DataFrame, score: str, points: int = FOREST_GRID_POINTS) -> list[float]:
    """Evenly spaced thresholds from the smallest to the largest score."""
    low, high = df.agg(F.min(score), F.max(score)).first()
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def percentile_grid(df: DataFrame, score: str, points: int = SEQUENCE_GRID[0], first: float = SEQUENCE_GRID[1],
                    last: float = SEQUENCE_GRID[2]) -> list[float]:
    """Distinct percentiles of the score, spaced evenly in rank."""
    wanted = [first + (last - first) * i / (points - 1) for i in range(points)]
    return sorted(set(percentiles(df, score, wanted)))


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float], above: bool = True) -> DataFrame:
    """Precision, recall and F1 of `score > t` (or `score < t`) for every threshold.

    Each row is counted once, in the interval between thresholds where its score lies; the per-threshold numbers are
    running sums over these counts, of which there are len(thresholds) + 1.
    """
    cuts = sorted(set(thresholds))
    x, y = F.col(score), F.col(label).cast("int")
    # Number of thresholds that flag the row.
    grid = F.array(*(F.lit(float(t)) for t in cuts))
    flagged_by = F.size(F.filter(grid, lambda t: x > t if above else x < t))
    counts = df.where(x.isNotNull()).groupBy(flagged_by.alias("k")).agg(
        F.count("*").alias("n"), F.sum(y).alias("pos"))
    spark = df.sparkSession
    # A row flagged by k thresholds is flagged by the k lowest ones (above) or the k highest ones (below).
    grid_rows = [(t, i + 1 if above else len(cuts) - i) for i, t in enumerate(cuts)]
    steps = spark.createDataFrame(grid_rows, "threshold double, k int")
    one = Window.partitionBy("_all").orderBy(F.desc("k"))
    whole = Window.partitionBy("_all")
    swept = (
        spark.createDataFrame([(k,) for k in range(len(cuts) + 1)], "k int")
        .join(counts, "k", "left").na.fill(0, ["n", "pos"]).withColumn("_all", F.lit(0))
        .withColumn("flagged", F.sum("n").over(one)).withColumn("tp", F.sum("pos").over(one))
        .withColumn("positives", F.sum("pos").over(whole))
    )
    quality = steps.join(swept, "k").withColumn("fp", F.col("flagged") - F.col("tp")).withColumn(
        "fn", F.col("positives") - F.col("tp"))
    return quality.select("threshold", "tp", "fp", "fn", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where undefined."""
    tp, fp, fn = (c.cast("double") for c in (tp, fp, fn))
    return [
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
    ]


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the smallest one on ties."""
    return sweep.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                              F.struct(F.col("f1"), -F.col("threshold"))).alias("b")).select("b.*")


def confusion(df: DataFrame, label: str, predictions: list[str]) -> DataFrame:
    """Confusion counts and quality per prediction column, from one pass."""
    y = F.coalesce(F.col(label).cast("boolean"), F.lit(False))

    def counts(name):
        p = F.coalesce(F.col(name).cast("boolean"), F.lit(False))
        return F.struct(
            F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
            F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")).alias(name)
    row = df.agg(*(counts(p) for p in predictions))
    wide = row.unpivot([], predictions, "detector", "c").select("detector", "c.*")
    return wide.select("*", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def recall_by(df: DataFrame, label: str, caught: str, key: str) -> DataFrame:
    """Share of the true anomalies that were caught, per `key`, lowest first."""
    return (
        df.where(F.col(label)).groupBy(key)
        .agg(F.avg(F.col(caught).cast("double")).alias("recall"), F.count("*").alias("n_readings"))
        .orderBy("recall", key)
    )


def recall_report(df: DataFrame, label: str, caught: str, keys: list[str]) -> DataFrame:
    """`recall_by` for several keys in one pass: columns dimension, member, recall, n_readings."""
    grouped = df.where(F.col(label)).groupingSets([[k] for k in keys], *keys).agg(
        F.avg(F.col(caught).cast("double")).alias("recall"),
        F.count("*").alias("n_readings"),
        *(F.grouping(k).alias(f"_g_{k}") for k in keys),
    )
    dimension, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        here = F.col(f"_g_{k}") == 0
        dimension = F.when(here, k).otherwise(dimension)
        member = F.when(here, F.col(k).cast("string")).otherwise(member)
    return grouped.select(dimension.alias("dimension"), member.alias("member"), "recall", "n_readings")


def first_false_positive(df: DataFrame, label: str, predicted: str, order: list[str]) -> DataFrame:
    """The earliest row that was predicted positive and is not."""
    wrong = df.where(F.col(predicted).cast("boolean") & ~F.col(label).cast("boolean"))
    return wrong.agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).where("r IS NOT NULL").select("r.*")


def most_confident(df: DataFrame, probability: str, order: list[str]) -> DataFrame:
    """The row with the highest probability; the earliest on ties."""
    place = F.struct(-F.col(probability), *order)
    return df.where(F.col(probability).isNotNull()).agg(
        F.min_by(F.struct(*df.columns), place).alias("r")).where("r IS NOT NULL").select("r.*")
