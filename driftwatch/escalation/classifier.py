"""Will an anomaly turn severe? Boosted trees on early readings."""

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from driftwatch.catalog import (
    BOOSTED_DEPTH as DEPTH,
    BOOSTED_STEP as STEP,
    BOOSTED_TREES as TREES,
    ESCALATION_FEATURES,
    SEED,
)

# A missing value becomes a number outside the feature's range, which a split can set apart.
MISSING = {"zscore_value": -1.0, "iforest_score": -10.0, "lstm_error": -1.0}


def inputs(features: list[str] = ESCALATION_FEATURES) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(MISSING.get(c, 0.0))) for c in features]


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    names = [f"_in_{c}" for c in features]
    filled = df.withColumns(dict(zip(names, inputs(features))))
    return VectorAssembler(inputCols=names, outputCol="_features").transform(filled).drop(*names)


def fit(train: DataFrame, label: str = "will_be_severe", features: list[str] = ESCALATION_FEATURES,
        trees: int = TREES, depth: int = DEPTH) -> GBTClassificationModel:
    """Positives weigh n_negative / n_positive, so that both classes count the same."""
    n, positive = train.agg(F.count("*"), F.sum(label)).first()
    if not positive or positive == n:
        raise ValueError("the training rows hold one class only")
    weighted = _assembled(train, features).withColumn(
        "_weight", F.when(F.col(label) == 1, (n - positive) / positive).otherwise(1.0))
    return GBTClassifier(
        featuresCol="_features", labelCol=label, weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=STEP,
        seed=SEED,
    ).fit(weighted.select("_features", "_weight", F.col(label).cast("double").alias(label)))


def predict(model: GBTClassificationModel, df: DataFrame, features: list[str] = ESCALATION_FEATURES) -> DataFrame:
    """Add `escalation_probability`, `escalation_margin` (its log-odds) and `predicted_severe`."""
    scored = model.transform(_assembled(df, features))
    # The model's probability is the logistic function of twice its raw score.
    return scored.withColumns({
        "escalation_probability": vector_to_array("probability")[1],
        "escalation_margin": 2.0 * vector_to_array("rawPrediction")[1],
        "predicted_severe": F.col("prediction").cast("int"),
    }).drop("_features", "rawPrediction", "probability", "prediction")


def importances(model: GBTClassificationModel, spark, features: list[str] = ESCALATION_FEATURES) -> DataFrame:
    """Share of the total split gain per feature, largest first."""
    rows = [(f, float(g)) for f, g in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
