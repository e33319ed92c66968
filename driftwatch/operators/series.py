"""Keyed time series cut into chunks, so that no window has to hold one whole key.

A plain `Window.partitionBy(service)` puts every row of a service into one task. A busy service may own a third of all
rows, so busy keys are cut into time chunks here. Each chunk carries copies of the rows that precede it (the look-back),
which makes every "previous n rows" window exact. Values that depend on all earlier rows (streaks, sessions) are
computed per chunk and then joined up from one summary row per chunk.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from driftwatch.storage import stage

CHUNK = "_chunk"
COPY = "_copy"
CUT = "_cut"

# One rule for tables of every size: a key with more rows than this is cut into chunks of about this many.
ROWS_PER_CHUNK = 200_000
CELL_SECONDS = 10
_CELL_MICROS = CELL_SECONDS * 1_000_000


@dataclass(frozen=True)
class Widths:
    """Where the chunks of the keys begin that are too big for one task; all other keys stay whole."""

    keys: tuple[str, ...]
    rows_per_chunk: int
    # (keys, _cell, _n, _before): rows of a cell of time and rows of the key before it. None if no key is cut.
    cells: DataFrame | None

    def tag(self, df: DataFrame, ts: str) -> DataFrame:
        """Add the chunk number, and whether the row's key is cut (a whole key is chunk 0).

        The cells are joined by key and cell; Spark broadcasts them only if they are small.
        """
        if self.cells is None:
            return df.withColumns({CUT: F.lit(False), CHUNK: F.lit(0).cast("long")})
        micros = F.unix_micros(ts)
        # Within a cell the place is estimated from the time; it only rises with the time.
        share = F.pmod(micros, F.lit(_CELL_MICROS)) / F.lit(_CELL_MICROS)
        chunk = F.floor((F.col("_before") + F.floor(share * F.col("_n"))) / self.rows_per_chunk)
        placed = df.withColumn("_cell", F.floor(micros / _CELL_MICROS)).join(self.cells, [*self.keys, "_cell"], "left")
        return placed.select(*df.columns, F.col("_n").isNotNull().alias(CUT),
                             F.coalesce(chunk, F.lit(0)).cast("long").alias(CHUNK))


def measure(df: DataFrame, keys: list[str], ts: str, rows_per_chunk: int | None = None) -> Widths:
    """Count the rows of each key by cells of time and number them through, for keys of more than `rows_per_chunk` rows.

    Reads only `keys` and `ts`. A chunk gets about `rows_per_chunk` rows however unevenly these lie in time, since the cells
    of a chunk are added up; only rows closer together than a cell may exceed it. The result holds for any subset of the rows
    as well: measure a stored table once and pass the result on to the steps derived from it.
    """
    rows_per_chunk = rows_per_chunk or ROWS_PER_CHUNK
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        df.groupBy(*keys, F.floor(F.unix_micros(ts) / _CELL_MICROS).alias("_cell")).agg(F.count("*").alias("_n"))
        .withColumns({"_all": F.sum("_n").over(by_key), "_before": F.coalesce(F.sum("_n").over(before), F.lit(0))})
        .where(F.col("_all") > rows_per_chunk).drop("_all")
    )
    cells = stage(cells, "cells")
    return Widths(tuple(keys), rows_per_chunk, None if cells.isEmpty() else cells)


@dataclass(frozen=True)
class Series:
    """Rows of many series with their chunk; `order` must be a total order within a key and start with the time."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    # False when every key is one chunk.
    cut: bool = True

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    def previous(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-n, -1)

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(1 - n, 0)

    def with_columns(self, columns: dict[str, Column]) -> "Series":
        return replace(self, df=self.df.withColumns(columns))

    def rows(self) -> DataFrame:
        """The input rows, without the look-back copies."""
        return self.df.where(~F.col(COPY)).drop(CHUNK, COPY)


def series(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lookback: int,
    rows_per_chunk: int | None = None,
    widths: Widths | None = None,
) -> Series:
    """Prepare `df` for windows that reach at most `lookback` rows back.

    The rows go through one shuffle, when the first window runs. Only keys that are cut need copies; these come from a second,
    narrow pass in which each map task keeps just the last `lookback` rows of a chunk before it shuffles them.
    """
    keys = list(keys)
    widths = widths or measure(df, keys, order[0], rows_per_chunk)
    tagged = widths.tag(df, order[0])
    main = tagged.select(*df.columns, CHUNK, F.lit(False).alias(COPY))
    if lookback == 0 or widths.cells is None:
        return Series(main, tuple(keys), tuple(order), widths.cells is not None)
    cut = tagged.where(CUT).drop(CUT)

    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = (
        cut.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(by_key))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    # A later chunk needs a row when fewer than `lookback` rows lie between the row and the chunk's first row.
    followers = F.collect_list(F.struct(CHUNK, "_start")).over(by_key.rowsBetween(1, lookback))
    needs = ends.select(*keys, CHUNK, "_end", followers.alias("_later")).withColumn(
        "_later", F.filter("_later", lambda c: c["_start"] - F.col("_end") < lookback)).where(F.size("_later") > 0)

    newest = Window.partitionBy(*keys, CHUNK).orderBy(*(F.desc(c) for c in order))
    copies = (
        cut.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= lookback)
        .join(needs, [*keys, CHUNK])
        .withColumn("_to", F.explode("_later"))
        .where(F.col("_rank") + F.col("_to")["_start"] - F.col("_end") <= lookback)
        .withColumn(CHUNK, F.col("_to")[CHUNK])
        .select(*df.columns, CHUNK, F.lit(True).alias(COPY))
    )
    return Series(main.unionByName(copies), tuple(keys), tuple(order))


def without_copies(s: Series) -> Series:
    return replace(s, df=s.df.where(~F.col(COPY)))


def stored(s: Series, name: str) -> Series:
    """The rows without copies, written once if a following step would have to derive them twice."""
    s = without_copies(s)
    return replace(s, df=stage(s.df, name)) if s.cut else s


def streak(s: Series, flag: str, name: str, initial: str | None = None) -> Series:
    """Number of consecutive rows with `flag` true up to and including the row, as column `name`.

    `initial` names a column with the run that the key brings along from before its first row here.

    The run inside a chunk is counted locally; one summary row per chunk then says how long a run enters the next one.
    Chunks make this read `s` twice, so pass costly rows through `stored` first.
    """
    s = without_copies(s)
    keys = list(s.keys)
    temporary = ["_on", "_before", "_run", "_enters"]
    on = F.coalesce(F.col(flag), F.lit(False)).cast("long")
    local = (
        s.df.withColumn("_on", F.sum(on).over(s.window))
        .withColumn("_before", F.max(F.when(on == 0, F.col("_on"))).over(s.window))
        .withColumn("_run", F.col("_on") - F.coalesce("_before", F.lit(0)))
    )
    brought = F.coalesce(F.col(initial), F.lit(0)) if initial else F.lit(0)
    if not s.cut:
        run = F.col("_run") + F.when((on == 1) & F.col("_before").isNull(), brought).otherwise(0)
        return replace(s, df=local.withColumn(name, run).drop(*temporary))
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    ends = (
        local.groupBy(*keys, CHUNK).agg(
            F.max_by("_run", F.struct(*s.order)).alias("_tail"),
            F.max(1 - on).alias("_broken"),
            F.max(brought).alias("_brought"),
        )
        # A chunk with an unflagged row starts a new island; flagged-only chunks prolong the run of the island.
        .withColumn("_island", F.sum("_broken").over(by_key))
        .withColumn("_carried", F.sum("_tail").over(Window.partitionBy(*keys, "_island").orderBy(CHUNK)))
        .withColumn("_enters", F.coalesce(F.lag("_carried").over(by_key), F.lit(0)) + F.when(
            F.coalesce(F.lag("_island").over(by_key), F.lit(0)) == 0, F.col("_brought")).otherwise(0))
        .select(*keys, CHUNK, "_enters")
    )
    entering = F.when(F.col("_before").isNull(), F.coalesce("_enters", F.lit(0))).otherwise(0)
    joined = (
        local.join(ends, [*keys, CHUNK], "left")
        .withColumn(name, F.col("_run") + F.when(on == 1, entering).otherwise(0))
        .drop(*temporary)
    )
    return replace(s, df=joined)


def sessions(s: Series, gap_seconds: float, latest: list[str], maxima: list[str]) -> DataFrame:
    """Merge rows of a key whose distance in time is at most `gap_seconds` into intervals.

    Result: keys, started_at, last_seen_at, occurrence_count, the `latest` columns of the newest row and the maximum of
    each of `maxima`. Intervals are built per chunk; only the first and last interval of a chunk can touch a neighbour,
    so only these are merged across chunks.
    """
    s = without_copies(s)
    keys, ts = list(s.keys), s.order[0]
    gap = int(gap_seconds * 1_000_000)

    def opens(start, end_before):
        return (end_before.isNull() | (F.unix_micros(start) - F.unix_micros(end_before) > gap)).cast("long")

    snapshot = F.struct(*latest) if latest else F.struct(F.lit(0).alias("_none"))
    within = (
        s.df.withColumn("_opens", opens(F.col(ts), F.lag(ts).over(s.window)))
        .withColumn("_no", F.sum("_opens").over(s.window))
        .groupBy(*keys, CHUNK, "_no").agg(
            F.min(ts).alias("started_at"),
            F.max(ts).alias("last_seen_at"),
            F.count("*").alias("occurrence_count"),
            F.max_by(snapshot, F.struct(*s.order)).alias("_latest"),
            *(F.max(m).alias(m) for m in maxima),
        )
    )
    shown = [*keys, "started_at", "last_seen_at", "occurrence_count", *maxima,
             *(F.col(f"_latest.{c}").alias(c) for c in latest)]
    if not s.cut:
        return within.select(*shown)
    # Inner intervals of a chunk are too far apart to merge, so they stay with their chunk; all edges of a key meet.
    within = within.withColumn("_count", F.max("_no").over(Window.partitionBy(*keys, CHUNK)))
    at_edge = (F.col("_no") == 1) | (F.col("_no") == F.col("_count"))
    place = F.when(~at_edge, F.col(CHUNK))
    meeting = Window.partitionBy(*keys, "_place").orderBy("started_at")
    across = (
        within.withColumn("_place", place)
        .withColumn("_opens", opens(F.col("started_at"), F.lag("last_seen_at").over(meeting)))
        .withColumn("_no", F.sum("_opens").over(meeting))
        .groupBy(*keys, "_place", "_no").agg(
            F.min("started_at").alias("started_at"),
            F.max_by("_latest", "last_seen_at").alias("_latest"),
            F.sum("occurrence_count").alias("occurrence_count"),
            F.max("last_seen_at").alias("last_seen_at"),
            *(F.max(m).alias(m) for m in maxima),
        )
    )
    return across.select(*shown)
