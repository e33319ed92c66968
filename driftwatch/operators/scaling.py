"""Standard scaling with statistics of the training rows only."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from driftwatch.catalog import FEATURES


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column; a constant column keeps scale 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @staticmethod
    def fit(train: DataFrame, columns: list[str] = FEATURES) -> "Scaler":
        """One pass; the driver receives two numbers per column."""
        row = train.agg(
            *(F.avg(c).alias(f"m_{c}") for c in columns),
            *(F.stddev_pop(c).alias(f"s_{c}") for c in columns),
        ).first()
        stds = (row[f"s_{c}"] for c in columns)
        return Scaler(tuple(columns), tuple(row[f"m_{c}"] for c in columns), tuple(s if s else 1.0 for s in stds))

    def _parts(self):
        return zip(self.columns, self.means, self.stds)

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c) - m) / s for c, m, s in self._parts()})

    def inverse(self, df: DataFrame, suffix: str = "_scaled", to: str = "_raw") -> DataFrame:
        return df.withColumns({c + to: F.col(c + suffix) * s + m for c, m, s in self._parts()})

    def vector(self):
        """The scaled features as one array column."""
        return F.array(*((F.col(c) - m) / s for c, m, s in self._parts()))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [Row(position=i, feature=c, mean=m, std=s) for i, (c, m, s) in enumerate(self._parts())]
        return spark.createDataFrame(rows, "position int, feature string, mean double, std double")

    @staticmethod
    def from_df(df: DataFrame) -> "Scaler":
        rows = df.orderBy("position").collect()
        return Scaler(tuple(r.feature for r in rows), tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows))
