"""Exact copies by sorting contents: sampled range partitions, external sorting, comparison of neighbours."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.storage import stage

HEAD = 32  # leading characters that lead the sort order, before the digest
ROWS_OUT = 10_000
SCHEMA = "doc_id long, keep_id long, group_size long, first boolean, text_sha256 string, part int, edge boolean"


def _neighbours(keep):
    """Walk through sorted rows (doc_id, content, digest), compare each whole content with the one before, and close
    each run of equal ones. Only the doc_ids of one run and one content are held."""
    pick = max if keep == "largest" else min

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, out, content, digest, edge = [], [], None, None, True

        def close(last):
            known = [i for i in ids if i is not None]
            best = pick(known) if known else None
            at_edge = edge or last
            for k, i in enumerate(ids):
                out.append((i, best, len(ids), not k or i != ids[k - 1], digest, part, at_edge))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.bool_()), strict=True)],
                ["doc_id", "keep_id", "group_size", "first", "text_sha256", "part", "edge"])

        for batch in batches:
            for i, new, sha in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                new = new.as_py()
                if digest is None or sha != digest or new != content:
                    if digest is not None:
                        close(False)
                        ids, edge = [], False
                    content, digest = new, sha
                ids.append(i)
                if len(out) >= ROWS_OUT:
                    yield table(out)
                    out.clear()
        if digest is not None:
            close(True)
        for a in range(0, len(out), ROWS_OUT):
            yield table(out[a : a + ROWS_OUT])

    return run


def exact_duplicates(docs: DataFrame, normal=None, keep: str = "smallest") -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    `normal` makes the content that is compared from the text column (default: the text); null counts as empty, and
    empty texts are copies of each other. `keep_id` is the smallest (or "largest") doc_id among rows of equal content. kept marks its row; of
    rows that repeat a doc_id and content, one. A null doc_id is never chosen over another; a group without any doc_id
    keeps one row. Other columns do not matter, an empty table gives an empty result.

    Sampled splitters over (first characters, digest, doc_id) cut the rows into ranges; so only short keys are sampled,
    and a group of very many copies is cut between its doc_ids. Groups that reach over a cut are joined up from the first
    and the last run of each range, which have one digest on both sides of a cut.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = text if normal is None else F.coalesce(normal(text), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content.alias("content")).withColumn(
        "digest", F.sha2("content", 256))
    head = F.substring("content", 1, HEAD)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = stage(keyed.repartitionByRange(parts, head, "digest", "doc_id")
                 .sortWithinPartitions(head, "digest", "content", "doc_id")
                 .select("doc_id", F.col("content").cast("binary").alias("content"), "digest")
                 .mapInArrow(_neighbours(keep), SCHEMA), "runs")
    pick = F.max if keep == "largest" else F.min
    # at most two runs of each range, whatever the number of rows
    edges = F.broadcast(
        runs.where("edge").groupBy("text_sha256", "part")
        .agg(pick("keep_id").alias("edge_id"), F.first("group_size").alias("size"))
        .groupBy("text_sha256").agg(pick("edge_id").alias("edge_id"), F.sum("size").alias("size")))
    joined = runs.join(edges, "text_sha256", "left").select(
        "doc_id", F.coalesce("edge_id", "keep_id").alias("keep_id"), F.coalesce("size", "group_size").alias("group_size"),
        "first", "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size",
                         (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
