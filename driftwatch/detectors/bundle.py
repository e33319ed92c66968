"""The trained detectors: fitting, storing, loading and scoring."""

import warnings
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwatch.catalog import FEATURES, SEQUENCE_ROWS, ZSCORE_GRID
from driftwatch.detectors import forest as isolation
from driftwatch.detectors.forest import Forest
from driftwatch.detectors.sequence import COMPONENTS, SequenceModel
from driftwatch.functions.columns import vote
from driftwatch.operators import evaluation
from driftwatch.operators.rolling import (
    REPLAY_LOOKBACK,
    SEQUENCE_LOOKBACK,
    add_features,
    add_sequence,
    add_trend,
    check_feature_order,
    sequences,
    stretches,
)
from driftwatch.operators.scaling import Scaler
from driftwatch.operators.series import CHUNK, COPY, Series, Widths, series, streak
from driftwatch.storage import stage

VALUES = ["zscore_value", "iforest_score", "lstm_error"]
FLAGS = ["zscore_flag", "iforest_flag", "lstm_flag"]
SCORE_COLUMNS = [*VALUES, *FLAGS, "votes", "available", "ensemble_score", "ensemble_is_anomaly", "model_version"]


@dataclass(frozen=True)
class Bundle:
    """Trained parts; a missing part only disables its own detector."""

    scaler: Scaler | None = None
    zscore_threshold: float | None = None
    forest: Forest | None = None
    forest_threshold: float | None = None
    sequence: SequenceModel | None = None
    sequence_threshold: float | None = None
    sequence_length: int = SEQUENCE_ROWS
    version: str = "v1"

    def save(self, spark: SparkSession, path: str) -> None:
        if self.scaler:
            self.scaler.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        if self.forest:
            spark.createDataFrame(self.forest.nodes, isolation.NODES).write.mode("overwrite").parquet(
                f"{path}/forest")
        if self.sequence:
            self.sequence.center.write().overwrite().save(f"{path}/sequence-center")
            self.sequence.components.write().overwrite().save(f"{path}/sequence-components")
        rows = []
        columns = list(self.scaler.columns) if self.scaler else []
        if self.zscore_threshold is not None:
            rows.append(("zscore", self.version, self.zscore_threshold, columns, {}))
        if self.forest and self.forest_threshold is not None:
            rows.append(("iforest", self.version, self.forest_threshold, columns,
                         {"size": float(self.forest.size), "offset": self.forest.offset}))
        if self.sequence and self.sequence_threshold is not None:
            rows.append(("lstm", self.version, self.sequence_threshold, columns,
                         {"length": float(self.sequence_length)}))
        spark.createDataFrame(
            rows, "detector string, version string, threshold double, feature_cols array<string>,"
                  " params map<string,double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bundle":
        """Load what is there; a part whose folder is missing stays None, with a warning. A damaged part is an error."""
        def optional(read):
            try:
                return read()
            except Exception as error:
                absent = isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"
                if not absent and "Input path does not exist" not in str(error):
                    raise
                warnings.warn(f"{path}: a part of the bundle is missing, its detector is off", stacklevel=2)
                return None
        config = optional(lambda: {r["detector"]: r for r in spark.read.parquet(f"{path}/config").collect()}) or {}
        bundle = Bundle(scaler=optional(lambda: Scaler.from_df(spark.read.parquet(f"{path}/scaler"))))
        for row in config.values():
            if bundle.scaler:
                check_feature_order(row["feature_cols"], list(bundle.scaler.columns))
            bundle = replace(bundle, version=row["version"])
        if "zscore" in config:
            bundle = replace(bundle, zscore_threshold=config["zscore"]["threshold"])
        nodes = optional(lambda: spark.read.parquet(f"{path}/forest").toPandas())
        if nodes is not None and "iforest" in config:
            row = config["iforest"]
            bundle = replace(bundle, forest_threshold=row["threshold"], forest=Forest(
                nodes.sort_values(["tree", "node"]), int(row["params"]["size"]), row["params"]["offset"]))
        center = optional(lambda: StandardScalerModel.load(f"{path}/sequence-center"))
        components = optional(lambda: PCAModel.load(f"{path}/sequence-components"))
        if center and components and "lstm" in config:
            row = config["lstm"]
            bundle = replace(bundle, sequence=SequenceModel(center, components), sequence_threshold=row["threshold"],
                             sequence_length=int(row["params"]["length"]))
        return bundle


def scaled(scaler: Scaler) -> list[Column]:
    return [(F.col(c) - m) / s for c, m, s in zip(scaler.columns, scaler.means, scaler.stds)]


def score(s: Series, bundle: Bundle, keep: list[str] | None = None) -> Series:
    """Detector values, flags and the vote for every row of a series with its features.

    With `keep`, only these columns remain beside keys, order and scores, and the rows pass through the forest whole. Without it the forest is
    a column like the others, which is not computed if nobody asks for it; Spark queues the rows beside it, on disk if memory is short.
    """
    if bundle.scaler:
        check_feature_order(FEATURES, list(bundle.scaler.columns))
    none = F.lit(None).cast("double")
    ready = bundle.scaler is not None
    z = evaluation.worst_z() if ready and bundle.zscore_threshold is not None else none
    kept = [c for c in s.df.columns if keep is None or c in {*s.keys, *s.order, *keep, CHUNK, COPY}]
    # The forest comes last: rows that return from Python would have to be shuffled and sorted again for the sequences.
    if ready and bundle.sequence:
        s = s.with_columns({"_vector": bundle.scaler.vector()})
        s = add_sequence(s, "_vector", "_sequence", bundle.sequence_length)
        s = replace(s, df=bundle.sequence.add_error(s.df, "_sequence").drop("_vector", "_sequence"))
    else:
        s = s.with_columns({"lstm_error": none})
    no = F.lit(False)
    # The flag goes with the forest: as the error is used twice there, it is computed before, and no row waits for the forest with its sequence.
    s = s.with_columns({"zscore_value": z, "lstm_flag": F.coalesce(F.col("lstm_error") > F.lit(bundle.sequence_threshold), no)})
    kept = [c for c in dict.fromkeys([*kept, "lstm_error", "zscore_value", "lstm_flag"]) if c != "iforest_score"]
    if not (ready and bundle.forest):
        s = replace(s, df=s.df.select(*kept, none.alias("iforest_score")))
    elif keep is None:
        s = s.with_columns({"iforest_score": bundle.forest.decision(s.df.sparkSession, scaled(bundle.scaler))})
    else:
        s = replace(s, df=bundle.forest.add_decision(s.df, scaled(bundle.scaler), "iforest_score", kept))
    s = s.with_columns({
        "zscore_flag": F.coalesce(F.col("zscore_value") > F.lit(bundle.zscore_threshold), no),
        "iforest_flag": F.coalesce(F.col("iforest_score") < F.lit(bundle.forest_threshold), no),
    })
    votes, available, total, verdict = vote([F.col(c) for c in FLAGS], [F.col(c) for c in VALUES])
    return s.with_columns({
        "votes": votes, "available": available, "ensemble_score": total, "ensemble_is_anomaly": verdict,
        "model_version": F.lit(bundle.version),
    })


def replay(ticks: DataFrame, bundle: Bundle, keys=("service_name",), order=("timestamp", "event_id"),
           widths: Widths | None = None, scale: int | None = 4, keep: list[str] | None = None) -> DataFrame:
    """Score the whole history as it would have been scored live, with the score trend and the anomaly streak.

    With `keep`, only these columns remain beside keys, order and scores, and only they are stored and shuffled on the way.
    """
    s = score(add_features(series(ticks, list(keys), list(order), REPLAY_LOOKBACK, widths=widths), scale=scale), bundle, keep)
    if keep is not None:
        s = replace(s, df=s.df.select(*dict.fromkeys([*keys, *order, *keep, *SCORE_COLUMNS]), CHUNK, COPY))
    if s.cut:  # the streak reads it twice; the trend needs the copies, and its window is that of the streak
        s = replace(s, df=stage(s.df, "replay"))
    return streak(add_trend(s, "ensemble_score"), "ensemble_is_anomaly", "consecutive_anomalous_ticks").rows()


def fit_bundle(rows: DataFrame, label: str = "is_anomaly", split: str = "split", key=("service_name", "timestamp"),
               keys=("service_name",), order=("timestamp", "event_id"), trees: int = isolation.TREES,
               components: int = COMPONENTS, widths: Widths | None = None) -> Bundle:
    """Train all detectors on labelled feature rows.

    Statistics, forest and components come from the training rows (the last two from normal ones only); thresholds
    maximise F1 on the training rows. `rows` is read many times: give a stored table.
    """
    scaler = Scaler.fit(rows.where(F.col(split) == "train"))
    train = rows.where(F.col(split) == "train")

    grid = evaluation.step_grid(*ZSCORE_GRID)
    bundle = Bundle(scaler=scaler, zscore_threshold=_best(
        train.withColumn("v", evaluation.worst_z()), label, grid, True))

    grown, scores = isolation.fit_scored(train, ~F.col(label), [label], scaled(scaler), list(key), trees)
    bundle = replace(bundle, forest=grown, forest_threshold=_best(
        scores, label, evaluation.linear_grid(scores, "v"), False))

    narrow = rows.select(*dict.fromkeys([*keys, *order, split, label]), scaler.vector().alias("_vector"))
    s = series(narrow, list(keys), list(order), SEQUENCE_LOOKBACK, widths=widths)
    # Shuffled and sorted once; every pass of the fit reads the stretches.
    stored = stage(stretches(s, "_vector", [split, label]), "stretches")
    windows = sequences(stored).where((F.col(split) == "train") & F.col("sequence").isNotNull())
    if windows.isEmpty():
        return bundle
    model = SequenceModel.fit(stored, lambda row: (row[split] == "train") & ~row[label], components=components)
    errors = stage(model.add_error(windows, name="v").select("v", label), "sequence-train")
    return replace(bundle, sequence=model, sequence_threshold=_best(
        errors, label, evaluation.percentile_grid(errors, "v"), True))


def _best(scores: DataFrame, label: str, grid: list[float], above: bool) -> float:
    return evaluation.best_threshold(evaluation.threshold_sweep(scores, "v", label, grid, above)).first()["threshold"]
