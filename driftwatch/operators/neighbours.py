"""Nearest row by Euclidean distance, exact and without comparing every pair.

Rows are assigned to the nearest of a few pivots. A query first looks into its own cell, which gives an upper bound of
its distance; by the triangle inequality it then only visits the cells that can hold something nearer. Cells are split
into blocks of bounded size, so neither a crowded cell nor many queries meet in one task, and copies of one vector are
compared once.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from driftwatch.storage import stage

PIVOTS = 64
BLOCK = 4096
# Keeps rounding errors of the bounds from hiding a neighbour.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of two blocks."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _best_in_block(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Nearest row of the block per query; the smallest id among equally near ones."""
    rows = rows.sort_values("row_id")
    ids, r = rows["row_id"].to_numpy(), _matrix(rows["vector"]) if len(rows) else None
    out = []
    for start in range(0, len(queries) if len(rows) else 0, 512):
        part = queries.iloc[start:start + 512]
        q = _matrix(part["vector"])
        d = distances(q, r)
        # The fast formula is inexact for near rows: compare the close ones again by subtraction.
        near = d <= d.min(axis=1, keepdims=True) + 1e-6 * (1.0 + np.abs(q).max())
        i, j = np.nonzero(near)
        exact = np.sqrt(((q[i] - r[j]) ** 2).sum(axis=1))
        out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[i], "row_id": ids[j], "distance": exact})
                   .sort_values(["query_id", "distance", "row_id"]).drop_duplicates("query_id"))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "row_id": [], "distance": []})


def _compare(queries: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """Best match per (query, cell); both sides carry `cell`. Blocks of a cell meet pairwise."""
    def parts(df, name):
        return df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # One row per cell, so at most PIVOTS rows.
    sizes = F.broadcast(parts(queries, "query_parts").join(parts(rows, "row_parts"), "cell"))

    def cut(df, ident, own, other):
        split = df.join(sizes, "cell")
        return split.withColumn(own[:-1], F.pmod(F.xxhash64(ident), F.col(own)).cast("int")).withColumn(
            other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        ).select("cell", "query_part", "row_part", ident, "vector")
    keys = ["cell", "query_part", "row_part"]
    return (
        cut(queries, "query_id", "query_parts", "row_parts").groupBy(*keys)
        .cogroup(cut(rows, "row_id", "row_parts", "query_parts").groupBy(*keys))
        .applyInPandas(_best_in_block, "query_id long, row_id long, distance double")
    )


def nearest(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, pivots: int = PIVOTS,
            block: int = BLOCK) -> DataFrame:
    """The nearest of `rows` for each of `queries`: columns query_id, row_id, distance.

    Ids are whole numbers; among equally near rows the smallest id wins.
    """
    as_doubles = F.col(vector).cast("array<double>").alias("vector")
    spark = rows.sparkSession
    single = rows.groupBy(as_doubles).agg(F.min(row_id).alias("row_id"))
    asked = queries.groupBy(as_doubles).agg(F.min(query_id).alias("query_id"))
    chosen = single.orderBy(F.xxhash64("vector"), "row_id").limit(pivots).collect()
    if not chosen:
        raise ValueError("no rows to match against")
    centers = np.array([r["vector"] for r in chosen], dtype=float)
    shared = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("array<double>")
    def to_pivots(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(distances(_matrix(vectors), shared.value)))

    def place(df):
        return df.withColumn("to_pivots", to_pivots("vector")).withColumn(
            "cell", (F.array_position("to_pivots", F.array_min("to_pivots")) - 1).cast("int"))
    placed = stage(place(single).withColumn("radius", F.array_min("to_pivots")).drop("to_pivots"), "match-rows")
    wanted = stage(place(asked), "match-queries")

    # Pass 1: the own cell. Every pivot is a row of its own cell, so no cell is empty.
    first = stage(_compare(wanted.drop("to_pivots"), placed.drop("radius"), block).groupBy("query_id").agg(
        F.min(F.struct("distance", "row_id")).alias("best")), "match-first")

    # Pass 2: cells that may hold a nearer row. One radius per pivot on the driver.
    radius = {r["cell"]: r["r"] for r in placed.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
    reach = np.array([radius.get(i, -np.inf) for i in range(len(centers))])
    gaps = distances(centers, centers)
    bounds = spark.sparkContext.broadcast((reach, gaps))

    @F.pandas_udf("array<int>")
    def cells_in_reach(to_pivots: pd.Series, cell: pd.Series, best: pd.Series) -> pd.Series:
        reach, gaps = bounds.value
        d, own = _matrix(to_pivots), cell.to_numpy()
        limit = (best.to_numpy() * (1 + SLACK) + SLACK)[:, None]
        ball = d - reach[None, :] <= limit
        # A row nearer to pivot i than to the own one lies beyond the plane between the two.
        nearest_own = d[np.arange(len(d)), own][:, None]
        plane = d * d - nearest_own * nearest_own <= 2.0 * gaps[own] * limit + SLACK
        plane[np.arange(len(d)), own] = False
        return pd.Series([np.flatnonzero(row) for row in ball & plane])

    visits = (
        wanted.join(first, "query_id")
        .withColumn("cell", F.explode(cells_in_reach("to_pivots", "cell", "best.distance")))
        .select("query_id", "vector", "cell")
    )
    second = _compare(visits, placed.drop("radius"), block)
    best = (
        second.select("query_id", F.struct("distance", "row_id").alias("best")).unionByName(first)
        .groupBy("query_id").agg(F.min("best").alias("best"))
    )
    # Back to all queries, copies included.
    matched = best.join(wanted.select("query_id", "vector"), "query_id").select("vector", "best")
    return (
        queries.select(F.col(query_id).alias("query_id"), as_doubles).join(matched, "vector", "left")
        .select("query_id", F.col("best.row_id").alias("row_id"), F.col("best.distance").alias("distance"))
    )


def match_report(matches: DataFrame, queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, label: str,
                 max_distance: float = 0.01, min_agreement: float = 0.99) -> DataFrame:
    """One row: largest and mean distance, share of equal labels, and whether the matching can be trusted."""
    joined = (
        matches.join(queries.select(F.col(query_id).alias("query_id"), F.col(label).alias("_a")), "query_id")
        .join(rows.select(F.col(row_id).alias("row_id"), F.col(label).alias("_b")), "row_id")
    )
    return joined.agg(
        F.max("distance").alias("max_distance"), F.avg("distance").alias("mean_distance"),
        F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("label_agreement"),
    ).withColumn("trustworthy",
                 (F.col("max_distance") < max_distance) & (F.col("label_agreement") > min_agreement))
