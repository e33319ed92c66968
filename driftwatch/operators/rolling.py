"""Features of a reading relative to the rows before it."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from driftwatch.catalog import DERIVED, FEATURES, FLAT_STD, HISTORY_ROWS, METRICS, SEQUENCE_ROWS, TREND_ROWS
from driftwatch.functions.columns import rounded
from driftwatch.operators.series import CHUNK, COPY, Series, Widths, series

ORDER = ["timestamp", "event_id"]
# Rows a sequence of features depends on, and the same with the score trend on top.
SEQUENCE_LOOKBACK = HISTORY_ROWS + SEQUENCE_ROWS - 1
REPLAY_LOOKBACK = SEQUENCE_LOOKBACK + TREND_ROWS
# Rows of a stretch, which holds the vectors before it besides.
STRETCH = 128


def rolling_columns(s: Series, value: str, prefix: str, rows: int = HISTORY_ROWS, ddof: int = 1,
                    scale: int | None = 4) -> dict[str, Column]:
    """Mean, z-score and change of `value` against the previous `rows` rows.

    Without history the mean is the value itself; the z-score is 0 until two rows exist and while they hardly vary.
    """
    part = f"PARTITION BY {', '.join([*s.keys, CHUNK])} ORDER BY {', '.join(s.order)}"
    before = f"OVER ({part} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    mean = f"avg({value}) {before}"
    # The deviation of fewer than two rows is NULL or 0, so it is never above the limit.
    std = f"{'stddev_samp' if ddof else 'stddev_pop'}({value}) {before}"
    formulas = {
        "rolling_avg": f"coalesce({mean}, {value})",
        "z_score": f"CASE WHEN {std} > {FLAT_STD}D THEN ({value} - {mean}) / {std} ELSE 0D END",
        "rate_of_change": f"coalesce({value} - lag({value}) OVER ({part}), 0D)",
    }
    return {prefix + name: rounded(F.expr(formula), scale) for name, formula in formulas.items()}


def add_features(s: Series, rows: int = HISTORY_ROWS, ddof: int = 1, scale: int | None = 4) -> Series:
    """The 21 derived feature columns beside the 7 metrics; all windows share one shuffle and one sort."""
    columns = {}
    for metric in METRICS:
        columns |= rolling_columns(s, metric, f"{metric}_", rows, ddof, scale)
    return s.with_columns(columns)


def features(ticks: DataFrame, keys=("service_name",), order=tuple(ORDER), rows: int = HISTORY_ROWS, ddof: int = 1,
             scale: int | None = 4, rows_per_chunk: int | None = None, widths: Widths | None = None) -> DataFrame:
    """The 28 feature columns of complete wide ticks."""
    s = series(ticks, list(keys), list(order), rows, rows_per_chunk, widths)
    return add_features(s, rows, ddof, scale).rows()


def narrow_features(readings: DataFrame, keys=("service_name", "metric_name"), order=tuple(ORDER),
                    rows: int = HISTORY_ROWS, ddof: int = 1, scale: int | None = 4,
                    rows_per_chunk: int | None = None, widths: Widths | None = None) -> DataFrame:
    """The same on narrow readings, where each metric keeps its own history; adds the `labels` struct."""
    s = series(readings, list(keys), list(order), rows, rows_per_chunk, widths)
    enriched = s.with_columns(rolling_columns(s, "value", "", rows, ddof, scale)).rows()
    return enriched.withColumn("labels", F.struct(*DERIVED)).drop(*DERIVED)


def feature_vector(columns: list[str] = FEATURES) -> Column:
    """The features as one array, in the fixed order."""
    return F.array(*(F.col(c).cast("double") for c in columns))


def check_feature_order(columns: list[str], trained: list[str]) -> None:
    """Refuse to score when the features are not those the detectors were trained on."""
    if list(columns) != list(trained):
        raise ValueError("feature columns differ from the trained ones in name or order")


def add_sequence(s: Series, vector: str, name: str = "sequence", length: int = SEQUENCE_ROWS,
                 include_current: bool = True) -> Series:
    """The last `length` vectors as one array; NULL while there are fewer.

    With `include_current=False` the window ends one row earlier.
    """
    frame = s.last(length) if include_current else s.previous(length)
    collected = F.collect_list(vector).over(frame)
    s = s.with_columns({name: collected})
    return s.with_columns({name: F.when(F.size(name) == length, F.col(name))})


def stretches(s: Series, vector: str, columns: list[str], length: int = SEQUENCE_ROWS) -> DataFrame:
    """Consecutive rows of a chunk, up to STRETCH in one row: `rows` (whether a look-back copy, `columns`), and `vectors` of these rows and of
    the length - 1 rows before them (fewer at the start of a chunk).

    A sequence for each row takes `length` times the room of its vector. Stretches take hardly more than the vectors: store them, and read the
    sequences as often as needed with `sequences`, without another shuffle or sort.
    """
    numbered = s.df.withColumn("_n", F.row_number().over(s.window)).select(
        "_n", F.col(vector).alias("vector"), F.struct(F.col(COPY).alias("copy"), *columns).alias("row"))
    schema = T.StructType([T.StructField("rows", T.ArrayType(numbered.schema["row"].dataType)),
                           T.StructField("vectors", T.ArrayType(numbered.schema["vector"].dataType))])

    def run(batches):
        held = None  # the vectors before the next row of its chunk
        for batch in batches:
            if not batch.num_rows:
                continue
            n, vectors, row = (batch.column(k) for k in range(3))
            places = n.to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(places[1:] == 1) + 1, len(places)]
            parts, sizes, counts, at = [], [], [], 0
            for end in ends:
                if held is None or places[at] == 1:
                    held = vectors.slice(0, 0)
                while at < end:
                    size = min(STRETCH, end - at)
                    here = pa.concat_arrays([held, vectors.slice(at, size)])
                    parts.append(here)
                    sizes.append(len(here))
                    counts.append(size)
                    held = here.slice(max(0, len(here) - length + 1))
                    at += size
            offsets = [pa.array(np.concatenate(([0], np.cumsum(x))), pa.int32()) for x in (counts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets[0], row), pa.ListArray.from_arrays(offsets[1], pa.concat_arrays(parts))],
                ["rows", "vectors"])

    return numbered.mapInArrow(run, schema)


def sequences(stored: DataFrame, name: str = "sequence", length: int = SEQUENCE_ROWS, vector: str | None = None) -> DataFrame:
    """The rows of `stretches` without copies, with the last `length` vectors of each; NULL while there are fewer.

    Further columns of `stored` are passed on; `vector` names a column for the row's own vector.
    """
    others = [c for c in stored.columns if c not in ("rows", "vectors")]
    last = F.size("vectors") - F.size("rows") + F.col("_at") + 1
    first = last + 1 - length
    each = stored.select(*others, "vectors", "rows", F.posexplode("rows").alias("_at", "_row")).where("not _row.copy")
    sequence = F.when(first >= 1, F.slice("vectors", F.greatest(first, F.lit(1)), F.lit(length)))
    own = [F.element_at("vectors", last).alias(vector)] if vector else []
    return each.select(*others, "_row.*", *own, sequence.alias(name)).drop("copy")


def add_trend(s: Series, score: str, name: str = "ensemble_score_trend", rows: int = TREND_ROWS) -> Series:
    """Score minus the score `rows` ticks earlier; NULL without that many."""
    return s.with_columns({name: F.col(score) - F.lag(score, rows).over(s.window)})
