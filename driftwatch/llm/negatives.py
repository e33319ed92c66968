"""Hard negatives: threshold joins on inner products, in the manner of L2AP.

Rows are cut into blocks, and every anchor asks every block for the rows whose score reaches its threshold. Inside a block the
dimensions lie in slabs, ordered by energy. The leading slabs of a row are left out of the inverted index as long as the norms of
these prefixes, of the row and of the asking anchors, cannot reach the threshold by themselves; partial scores gather from the last
slab backwards, and a pair is given up as soon as its partial score and the norms of what remains stay below the threshold. A
window that has not filled asks again with a lower threshold, down to its floor, so the thresholds decide the work and never the result.
"""

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm.sampling import bounded
from driftwatch.storage import stage

SLABS = 8
ROWS, ASKED = 8192, 2048  # members of a block, and anchors that ask it together
BATCH = 256  # anchors whose partial scores are held at once
SAMPLE = 1024  # rows that the first thresholds are estimated from
MORE, WIDER = 8, (8, 2, 1)  # how many more rows the next threshold expects; parts of a window that are asked for one after the other
LARGEST = 1 << 27  # of a component, so that scores fit 64 bits
FLOOR = -(1 << 62)  # a threshold that every score reaches


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v) with v = floor(scale * x) of each component of `embedding`, x as double.

    Rows take no part with a null vec_id, label or vector, or with a component that is null, not finite or at least 2^27 when scaled. Rows
    that repeat a vec_id count once: the one with the smallest label and vector.
    """
    def whole(x):
        scaled = x.cast("double") * scale
        return x.isNotNull() & ~F.isnan(scaled) & (F.abs(scaled) < LARGEST)

    good = rows.where("vec_id is not null and label is not null and embedding is not null").where(F.forall("embedding", whole))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", v.alias("v"))).alias("r"))
    return one.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("r.label").alias("label"), F.col("r.v").alias("v"))


def _matrix(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _norms(v, slabs):
    """Norms of the first 0, 1, 2 ... slabs of every row."""
    parts = [np.zeros(len(v))] + [(v[:, s].astype(float) ** 2).sum(axis=1) for s in slabs]
    return np.sqrt(np.cumsum(parts, axis=0)) * (1 + 1e-9)


def threshold_join(rows: np.ndarray, asked: np.ndarray, least: np.ndarray):
    """Yield (anchor, row, score) arrays of all pairs whose inner product reaches the anchor's threshold, one batch of anchors at a time."""
    width = rows.shape[1]
    exact = width * float(np.abs(rows).max(initial=0)) * float(np.abs(asked).max(initial=0)) < 2**52
    rows, asked = (x.astype(np.float64 if exact else np.int64) for x in (rows, asked))
    energy = np.argsort((rows.astype(float) ** 2).sum(axis=0), kind="stable")
    rows, asked = rows[:, energy], asked[:, energy]
    slabs = [slice(int(s[0]), int(s[-1]) + 1) for s in np.array_split(np.arange(width), min(SLABS, width))] if width else []
    row_norms, asked_norms = _norms(rows, slabs), _norms(asked, slabs)
    for start in range(0, len(asked), BATCH):
        q, t, qn = asked[start : start + BATCH], least[start : start + BATCH].astype(float), asked_norms[:, start : start + BATCH]
        # slabs at the head of each row that stay out of the index
        covered = row_norms * qn.max(axis=1, keepdims=True) < t.min()
        left_out = np.maximum(covered.sum(axis=0) - 1, 0)
        order = np.argsort(left_out, kind="stable")
        v, out, rn = rows[order], left_out[order], row_norms[:, order]
        lists = np.searchsorted(out, np.arange(len(slabs)), side="right")  # rows with a posting in each slab
        partial = np.zeros((len(q), len(v)), q.dtype)
        level = len(slabs)
        alive = np.ones(partial.shape, bool)
        while level and alive.size and alive.mean() > 0.2:
            level -= 1
            n = lists[level]
            partial[:, :n] += q[:, slabs[level]] @ v[:n, slabs[level]].T
            if level <= len(slabs) // 2:
                rest = np.maximum(out, level)
                alive = partial + qn[rest].T * rn[rest, np.arange(len(v))] + 1e-6 >= t[:, None]
        anchor, row = np.nonzero(alive)
        score, level = partial[anchor, row], np.maximum(out, level)[row]
        for k in range(int(level.max(initial=0)) - 1, -1, -1):
            todo = level > k
            a, r = anchor[todo], row[todo]
            score[todo] += (q[a][:, slabs[k]] * v[r][:, slabs[k]]).sum(axis=1)
            keep = score + qn[k, anchor] * rn[k, row] + 1e-6 >= t[anchor]
            anchor, row, score, level = anchor[keep], row[keep], score[keep], level[keep]
        keep = score >= t[anchor]
        yield anchor[keep] + start, order[row[keep]], score[keep].astype(np.int64)


def _first(group, size):
    """Which elements are among the first `size` of their group; groups lie together."""
    if not len(group):
        return np.zeros(0, bool)
    at = np.arange(len(group))
    heads = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
    return at - heads < size


def _search(same: bool, size: int):
    """Search a block for the anchors that ask it: the first `size` rows of each of their windows (rank, least, most)."""
    def run(batches):
        for batch in batches:
            for members, asking in zip(batch.column(0), batch.column(1), strict=True):
                members, asking = members.values, asking.values
                ids, labels = (members.field(k).to_numpy(zero_copy_only=False) for k in ("vec_id", "label"))
                names, own = (asking.field(k).to_numpy(zero_copy_only=False) for k in ("vec_id", "label"))
                windows = asking.field("windows")
                rank, least, most = (_matrix(pa.ListArray.from_arrays(windows.offsets, windows.values.field(k))) for k in ("rank", "least", "most"))
                given = np.arange(rank.shape[1]) < np.diff(windows.offsets.to_numpy())[:, None]
                rows, v = _matrix(members.field("v")), _matrix(asking.field("v"))
                width = max(rows.shape[1], v.shape[1])
                rows, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, v))
                lowest = np.where(given, least, 2**62).min(axis=1)
                for anchor, row, score in threshold_join(rows, v, lowest):
                    fits = (labels[row] == own[anchor]) & (ids[row] != names[anchor]) if same else labels[row] != own[anchor]
                    anchor, row, score = anchor[fits], row[fits], score[fits]
                    order = np.lexsort((ids[row], -score, anchor))
                    anchor, row, score = anchor[order], row[order], score[order]
                    for k in range(rank.shape[1]):
                        inside = given[anchor, k] & (score >= least[anchor, k]) & (score <= most[anchor, k])
                        a, r, s = anchor[inside], row[inside], score[inside]
                        best = _first(a, size)
                        a, r, s = a[best], r[best], s[best]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.int64()) for x in (names[a], rank[a, k], ids[r], s)], ["anchor_id", "window", "vec_id", "score"])
    return run


def _blocks(df: DataFrame, columns, n: int, name: str) -> DataFrame:
    block = F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(n)).cast("int").alias(name)
    return df.groupBy(block).agg(F.collect_list(F.struct(*columns)).alias(f"{name}s"))


def _ask(members: DataFrame, n_members: int, asking: DataFrame, n_asking: int, same: bool, size: int) -> DataFrame:
    """The first `size` rows of every window of `asking` (vec_id, label, v, windows), over all blocks."""
    n = -(-n_asking // ASKED)
    asking = _blocks(asking, ["vec_id", "label", "v", "windows"], n, "asked")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda df, name, k: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    left, right = (x.repartition(parts, "member", "asked") for x in (every(members, "asked", n), every(asking, "member", n_members)))
    found = left.join(right, ["member", "asked"]).select("members", "askeds").mapInArrow(
        _search(same, size), "anchor_id long, window long, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def _fill(members, n_members, windows: DataFrame, anchors: DataFrame, lower, same: bool, size: int) -> DataFrame:
    """Rows of all windows (anchor_id, window, least, most, step), lowering `least` of those that hold fewer than `size` rows."""
    out = None
    while True:
        asking = windows.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("window").alias("rank"), "least", "most")).alias("windows"))
        asking = stage(anchors.join(asking, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "asking")
        n = asking.count()
        if n == 0:
            break
        found = stage(_ask(members, n_members, asking, n, same, size), "window-rows")
        have = found.groupBy("anchor_id", "window").agg(F.count("*").alias("have"))
        state = stage(windows.join(have, ["anchor_id", "window"], "left").withColumn(
            "full", (F.coalesce("have", F.lit(0)) >= size) | (F.col("least") <= F.col("floor"))), "windows")
        full = found.join(state.where("full").select("anchor_id", "window"), ["anchor_id", "window"], "left_semi")
        out = full if out is None else out.unionByName(full)
        windows = lower(state.where("not full").drop("have", "full").withColumn("step", F.col("step") + 1))
    return out


def _estimates(rows: DataFrame, size: int):
    """Thresholds that about size * 4 * MORE ** step rows of an anchor's label reach, estimated from SAMPLE rows."""
    n = rows.count()
    picked = bounded(rows, "vec_id", SAMPLE).toArrow()
    sample, labels = _matrix(picked.column("v").combine_chunks()), picked.column("label").to_pylist()
    shares = {k: labels.count(k) / len(labels) for k in set(labels)}

    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), sample.shape[1])
            scores = v[:, : sample.shape[1]].astype(float) @ sample.T.astype(float)
            mean, spread = scores.mean(axis=1), scores.std(axis=1)
            part = [size * 4 * MORE ** step / (n * shares.get(label, 1 / SAMPLE))
                    for label, step in zip(batch.column("label").to_pylist(), batch.column("step").to_pylist(), strict=True)]
            least = [int(m + s * NormalDist().inv_cdf(1 - p)) if p < 0.5 else FLOOR for m, s, p in zip(mean, spread, part, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(least, pa.int64()), batch.column("step")],
                                             ["anchor_id", "least", "step"])

    def start(anchors):
        found = anchors.select("vec_id", "label", "v", "step").mapInArrow(run, "anchor_id long, least long, step int")
        return found.select("anchor_id", F.lit(0).cast("long").alias("window"), "least", F.lit(-FLOOR).alias("most"), F.lit(FLOOR).alias("floor"), "step")
    return n, start


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3,
                   low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, v) that meet the condition `anchors`, from `integer_vectors`.

    An anchor's positives are the first `positives` other rows of its label, by inner product and then by smaller vec_id. For each of
    them, of score p, come the first `negatives` rows of other labels whose score n has low * p <= n <= high * p (fractions): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Fewer rows are returned where there are fewer, none for an
    empty table. Vectors of unequal length count as if the shorter ended in zeros. Other columns do not matter.
    """
    rows = stage(rows.select("vec_id", "label", "v"), "vectors")
    n = rows.count()
    asked = rows.where(anchors)
    if n == 0 or asked.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                     "positive_score long, negative_score long")
    n_members = -(-n // ROWS)
    members = stage(_blocks(rows, ["vec_id", "label", "v"], n_members, "member"), "blocks")
    n, start = _estimates(rows, positives)

    def again(windows):
        return start(windows.select(F.col("anchor_id").alias("vec_id"), "step").join(asked, "vec_id"))

    first = start(asked.withColumn("step", F.lit(0)))
    found = _fill(members, n_members, first, asked, again, True, positives)
    best = stage(found.select("anchor_id", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"-((-positive_score * {low[0]}L - pmod(-positive_score * {low[0]}L, {low[1]}L)) div {low[1]}L)")
    most = F.expr(f"(positive_score * {high[0]}L - pmod(positive_score * {high[0]}L, {high[1]}L)) div {high[1]}L")

    def narrowed(windows):
        part = F.element_at(F.array(*map(F.lit, WIDER)), F.least(F.col("step") + 1, F.lit(len(WIDER))))
        return windows.withColumn("least", F.greatest(F.col("most") - F.expr("most - floor") / part, F.col("floor")).cast("long"))

    windows = narrowed(best.select("anchor_id", "window", most.alias("most"), least.alias("floor"), F.lit(0).alias("step"))
                       .where("floor <= most"))
    hard = _fill(members, n_members, windows, asked, narrowed, False, negatives)
    if hard is None:
        hard = found.where("false")
    return hard.join(best, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
