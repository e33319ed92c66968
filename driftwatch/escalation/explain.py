"""Additive explanations of the escalation model, and their wording."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwatch.catalog import (
    ESCALATION_FEATURES,
    REASONS,
    SENTENCE_CONFIDENCE,
    SENTENCE_END,
    SENTENCE_REASONS,
    SENTENCE_START,
    SENTENCE_VERDICTS,
    TOP_METRICS,
)
from driftwatch.escalation.classifier import inputs, predict
from driftwatch.functions.columns import percent_text, sigmoid
from driftwatch.storage import new_path

UNEXPLAINED = {"ensemble_score"}
CELLS = 1 << 21  # rows * leaves * places that are worked on at once


@dataclass(frozen=True)
class Leaves:
    """All leaves of the model, at most trees * 2 ** depth, with as many places each as the longest path has features.

    A feature on the path to a leaf is kept as the interval (low, high] that leads to the leaf and the share of training
    rows that follow it. Unused places hold an interval that always matches, with share 1.
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        """Expected log-odds before any feature is known."""
        return float((self.value * self.share.prod(axis=1)).sum())


def read_leaves(spark: SparkSession, model: GBTClassificationModel) -> Leaves:
    """Take the leaves from the stored form of the model, whose node table is bounded by the number of trees."""
    path = new_path(spark, "escalation-model")
    model.write().overwrite().save(path)
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    weights = model.treeWeights
    found = []
    for tree, nodes in trees.items():
        paths = [(0, {})]
        while paths:
            at, limits = paths.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                found.append((2.0 * weights[tree] * node["prediction"], limits))
                continue
            f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            lower, upper, kept = limits.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["leftChild"], (lower, min(upper, cut))),
                                  (node["rightChild"], (max(lower, cut), upper))):
                follows = nodes[child]["rawCount"] / node["rawCount"]
                paths.append((child, limits | {f: (*bounds, kept * follows)}))
    places = max(1, *(len(limits) for _, limits in found))
    filled = [[(f, *v) for f, v in limits.items()] + [(0, -np.inf, np.inf, 1.0)] * (places - len(limits)) for _, limits in found]
    feature, low, high, share = np.moveaxis(np.array(filled, dtype=float), 2, 0)
    return Leaves(np.array([value for value, _ in found]), feature.astype(int), low, high, share)


def shapley(x: np.ndarray, leaves: Leaves) -> np.ndarray:
    """Contribution of every input column to the log-odds of every row of `x`.

    A set of k of the other m - 1 places weighs k! (m - 1 - k)! / m!, which is the integral of t^k (1 - t)^(m - 1 - k) over
    0 to 1. So the sum over all sets is the integral of a product over the places, a polynomial that a few points integrate
    exactly: the work grows with the square of the depth, not with the number of sets. Places that always match do not change the
    values of the others.
    """
    out = np.zeros(x.shape)
    picked = x[:, leaves.feature]
    known = ((picked > leaves.low) & (picked <= leaves.high)).astype(float)
    points, weights = np.polynomial.legendre.leggauss((leaves.feature.shape[1] + 1) // 2)
    rest = np.zeros(known.shape)
    for t, weight in zip((points + 1) / 2, weights / 2):
        factor = leaves.share * (1 - t) + known * t
        others = np.full(known.shape, weight)
        others[:, :, 1:] *= np.cumprod(factor, axis=2)[:, :, :-1]
        others[:, :, :-1] *= np.cumprod(factor[:, :, ::-1], axis=2)[:, :, -2::-1]
        rest += others
    effect = leaves.value[:, None] * (known - leaves.share) * rest
    for f in range(x.shape[1]):
        out[:, f] = effect[:, leaves.feature == f].sum(axis=1)
    return out


def contributions(spark: SparkSession, leaves: Leaves, features: list[str] = ESCALATION_FEATURES) -> Column:
    """Struct with one contribution per feature."""
    shared = spark.sparkContext.broadcast((leaves.value, leaves.feature, leaves.low, leaves.high, leaves.share))
    names = list(features)

    @F.pandas_udf(", ".join(f"{f} double" for f in names))
    def explain(*columns: pd.Series) -> pd.DataFrame:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        known = Leaves(*shared.value)
        step = max(1, CELLS // known.feature.size)
        parts = [shapley(x[i:i + step], known) for i in range(0, len(x), step)]
        return pd.DataFrame(np.vstack(parts) if parts else x, columns=names)

    return explain(*inputs(names))


def top_contributions(struct: str = "contributions", features: list[str] = ESCALATION_FEATURES,
                      top: int = TOP_METRICS) -> Column:
    """The largest contributions by size as array of (feature, value, contribution), without rounding."""
    entries = F.array(*(
        F.struct((-F.abs(F.col(f"{struct}.{f}"))).alias("rank"), F.lit(i).alias("place"), F.lit(f).alias("feature"),
                 F.col(f).cast("double").alias("value"), F.col(f"{struct}.{f}").alias("contribution"))
        for i, f in enumerate(features) if f not in UNEXPLAINED
    ))
    return F.transform(F.slice(F.array_sort(entries), 1, top), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value"), e["contribution"].alias("contribution")))


def contributing_features(top: Column, scale: int = 4) -> Column:
    return F.transform(top, lambda e: F.struct(
        e["feature"].alias("feature"), F.round(e["value"], scale).alias("value"),
        F.round(e["contribution"], scale).alias("contribution")))


def _reason(entry: Column) -> Column:
    text = F.lit(None).cast("string")
    for feature, (up, down) in REASONS.items():
        phrase = F.when(entry["contribution"] > 0, up).otherwise(down)
        text = F.when(entry["feature"] == feature, phrase).otherwise(text)
    return text


def sentence(probability: Column, top: Column) -> Column:
    """One sentence with the verdict and up to three reasons."""
    reasons = F.array_compact(F.transform(top, _reason))

    def reason(i, lead):
        return F.when(F.size(reasons) > i, F.concat(F.lit(lead), F.get(reasons, F.lit(i)))).otherwise("")
    likely, unlikely = SENTENCE_VERDICTS
    before, after = SENTENCE_CONFIDENCE
    return F.concat(
        F.lit(SENTENCE_START), F.when(probability >= 0.5, likely).otherwise(unlikely),
        F.lit(before), percent_text(probability), F.lit(after),
        *(reason(i, lead) for i, lead in enumerate(SENTENCE_REASONS)), F.lit(SENTENCE_END))


def _told(told: DataFrame, features: list[str]) -> DataFrame:
    """Add sentence and top contributions to rows with `escalation_probability` and `contributions`."""
    told = told.withColumn("_top", top_contributions(features=features))
    p = F.col("escalation_probability")
    return told.withColumns({
        "explanation_text": sentence(p, F.col("_top")),
        "contributing_features": contributing_features(F.col("_top")),
    }).withColumn("escalation_probability", F.round(p, 4)).drop("_top")


def explain(df: DataFrame, model: GBTClassificationModel, features: list[str] = ESCALATION_FEATURES) -> DataFrame:
    """Add probability, sentence and top contributions to scored readings; `df` needs the feature columns."""
    spark = df.sparkSession
    leaves = read_leaves(spark, model)
    return _told(predict(model, df, features).withColumn("contributions", contributions(spark, leaves, features)), features)


def explain_leaves(df: DataFrame, leaves: Leaves, features: list[str] = ESCALATION_FEATURES) -> DataFrame:
    """The same from the leaves alone: contributions add up to the log-odds, so no model has to run beside them."""
    told = df.withColumn("contributions", contributions(df.sparkSession, leaves, features))
    margin = sum((F.col(f"contributions.{f}") for f in features), F.lit(leaves.base))
    return _told(told.withColumns({"escalation_margin": margin, "escalation_probability": sigmoid(margin)}), features)
