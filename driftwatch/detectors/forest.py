"""Isolation forest (Liu, Ting and Zhou 2008) on Spark.

The rows are sampled into trees by a hash of their key, so a forest does not depend on how the table is partitioned.
Every tree draws from all rows with the same chance for each row: first each row draws its number of trees (one hash,
0 for most rows of a large table), then which trees these are, at every size of the table.
Trees are grown in one task each from at most a few hundred rows; scoring is a batched function over the node table,
which has at most trees * (2 * sample - 1) rows.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from driftwatch.catalog import FOREST_CONTAMINATION as CONTAMINATION, FOREST_SAMPLE as SAMPLE, FOREST_TREES as TREES, SEED
from driftwatch.operators.quantiles import percentiles
from driftwatch.storage import stage

NODES = "tree int, node int, feature int, threshold double, left int, right int, path double"
HASHES = 1 << 52
ROWS = 2048  # that are scored at once


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


def grow(rows: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one tree; a leaf points to itself."""
    nodes: list[tuple] = []
    waiting = [(0, rows, 0)]
    used = 1
    while waiting:
        node, part, depth = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(low < high)
        if depth >= max_depth or len(part) <= 1 or len(usable) == 0:
            nodes.append((node, 0, np.inf, node, node, depth + expected_path(len(part))))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, used, used + 1, 0.0))
        waiting += [(used, part[goes_left], depth + 1), (used + 1, part[~goes_left], depth + 1)]
        used += 2
    return nodes


def _share(*key: Column | str) -> Column:
    """Uniform number below HASHES from the row key."""
    return F.pmod(F.xxhash64(*key), F.lit(HASHES))


def chances(trees: int, p: float) -> list[float]:
    """Chance that a row is drawn by at most k of the trees, each of which draws it with chance `p`, for k below `trees`."""
    return np.cumsum([math.comb(trees, k) * p**k * (1.0 - p) ** (trees - k) for k in range(trees)]).tolist()


def draw(rows: DataFrame, columns: list[Column], key: list[str], trees: int, p: float, seed: int) -> DataFrame:
    """(tree, draw, x0, x1, ...): each tree draws each row with chance `p`; `draw` is a random order."""
    limits = [min(HASHES, int(c * HASHES)) for c in chances(trees, p)]
    times = F.size(F.filter(F.array(*map(F.lit, limits)), lambda limit: limit <= F.col("_share")))
    places = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        F.xxhash64(*key, F.lit(seed + 1), t).alias("place"), t.alias("tree")))
    return (
        rows.withColumn("_share", _share(*key, F.lit(seed))).where(F.col("_share") >= limits[0])
        .withColumn("_drawn", F.explode(F.slice(F.array_sort(places), 1, times)))
        .withColumn("tree", F.col("_drawn.tree"))
        .withColumn("draw", _share(*key, F.lit(seed + 2), F.col("tree")))
        .select("tree", "draw", *(c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    )


def fit_nodes(rows: DataFrame, columns: list[Column], key: list[str], trees: int = TREES, sample: int = SAMPLE,
              seed: int = SEED) -> tuple[DataFrame, int]:
    """(node table, rows per tree). `key` names the columns that identify a row."""
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to grow the forest from")
    size = min(sample, n)
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    names = [f"x{i}" for i in range(len(columns))]
    # Twice the rows that a tree takes, so that hardly any tree falls short.
    drawn = draw(rows, columns, key, trees, min(1.0, 2.0 * size / n), seed)

    def grow_tree(tree_key: tuple, drawn_rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(tree_key[0])
        chosen = drawn_rows.sort_values(["draw", *names]).head(size)[names].to_numpy()
        nodes = grow(chosen, np.random.default_rng([seed, tree]), depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    return drawn.groupBy("tree").applyInPandas(grow_tree, NODES), size


@dataclass(frozen=True)
class Forest:
    """A grown forest: node table on the driver, rows per tree, offset of the decision value."""

    nodes: pd.DataFrame
    size: int
    offset: float = 0.0

    def _scorer(self, spark: SparkSession) -> Callable[[list[np.ndarray]], np.ndarray]:
        """Scores of rows that are given column by column, for use inside tasks; NaN where any input is NaN."""
        trees = []
        for _, part in self.nodes.groupby("tree"):
            part = part.sort_values("node")
            feature, threshold, left, right, path = (part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path"))
            trees.append((feature.astype(np.int64), threshold, np.stack([right, left], axis=1).ravel().astype(np.int64), path))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        shared = spark.sparkContext.broadcast(trees)
        scale = expected_path(self.size) or 1.0

        def score(columns: list[np.ndarray]) -> np.ndarray:
            n = len(columns[0])
            result = np.empty(n)
            for first in range(0, n, ROWS):
                x = np.column_stack([c[first:first + ROWS] for c in columns])
                flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
                total = np.zeros(len(x))
                for feature, threshold, children, path in shared.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        # the children of a node are (right, left)
                        at = children.take(2 * at + (flat.take(start + feature.take(at)) <= threshold.take(at)))
                    total += path.take(at)
                result[first:first + ROWS] = -np.exp2(-total / len(shared.value) / scale)
                result[first:first + ROWS][np.isnan(x).any(axis=1)] = np.nan
            return result
        return score

    def score_samples(self, spark: SparkSession, columns: list[Column]) -> Column:
        """-2 ** (-mean path / expected path); lower is stranger. NULL where any input is NULL."""
        scorer = self._scorer(spark)

        @F.pandas_udf("double")
        def score(*inputs: pd.Series) -> pd.Series:
            return pd.Series(scorer([c.to_numpy(dtype=float) for c in inputs]))

        # Arrow hands NaN through; the library's "no value" is NULL.
        return F.nanvl(score(*(c.cast("double") for c in columns)), F.lit(None).cast("double"))

    def decision(self, spark: SparkSession, columns: list[Column]) -> Column:
        return self.score_samples(spark, columns) - self.offset

    def add_decision(self, df: DataFrame, columns: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
        """The columns `keep` (all if not given) of `df` and the decision values as column `name`.

        For rows that come out of windows: only these columns and the inputs pass through Python. Beside a scalar function Spark
        would hold each row in a queue, with all that its other columns are still to be computed from, and let that queue grow on disk.
        """
        keep = df.columns if keep is None else keep
        rows = df.select(*keep, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
        schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
        scorer = self._scorer(df.sparkSession)

        def run(batches):
            for batch in batches:
                held, inputs = batch.columns[:len(keep)], batch.columns[len(keep):]
                values = scorer([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in inputs])
                yield pa.RecordBatch.from_arrays([*held, pa.array(values, from_pandas=True)], [*keep, name])

        return rows.mapInArrow(run, schema).withColumn(name, F.col(name) - self.offset)


def fit(rows: DataFrame, columns: list[Column], key: list[str], trees: int = TREES, sample: int = SAMPLE,
        contamination: float = CONTAMINATION, seed: int = SEED) -> Forest:
    """Grow the forest on normal rows; the offset is the `contamination` percentile of their scores."""
    return fit_scored(rows, F.lit(True), [], columns, key, trees, sample, contamination, seed)[0]


def fit_scored(rows: DataFrame, normal: Column, keep: list[str], columns: list[Column], key: list[str], trees: int = TREES,
               sample: int = SAMPLE, contamination: float = CONTAMINATION, seed: int = SEED) -> tuple[Forest, DataFrame]:
    """(the forest of the rows that are `normal`, decision value `v` and columns `keep` of all rows), scoring each row once."""
    spark = rows.sparkSession
    nodes, size = fit_nodes(rows.where(normal), columns, key, trees, sample, seed)
    forest = Forest(nodes.toPandas().sort_values(["tree", "node"]), size)
    scores = stage(rows.select(forest.score_samples(spark, columns).alias("v"), normal.alias("_normal"), *keep), "forest-scores")
    offset = percentiles(scores.where("_normal"), "v", [100.0 * contamination])[0]
    return Forest(forest.nodes, size, offset), scores.select((F.col("v") - offset).alias("v"), *keep)
