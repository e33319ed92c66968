"""Queries: nearest rows."""

from pyspark.sql import functions as F

from driftwatch.operators import neighbours
from driftwatch.plans import views
from driftwatch.plans.registry import query


def drifted(spark, sf):
    """The vectors with the small errors that storing them in less precision makes."""
    rows = views.table(spark, sf, "embeddings")
    return rows.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)))


_PAIRS = """
    with q as (select vec_id, label, [round(x::double, 2) for x in embedding] as e from embeddings),
    pairs as (select q.vec_id as query_id, r.vec_id as row_id, q.label as a, r.label as b,
                     list_distance(q.e, r.embedding::double[]) as distance from q, embeddings r),
    best as (select * from pairs qualify row_number() over (partition by query_id order by distance, row_id) = 1)"""


@query("J6", _PAIRS + " select query_id, row_id, round(distance, 6) as distance from best")
def nearest_rows(spark, sf):
    found = neighbours.nearest(drifted(spark, sf), views.table(spark, sf, "embeddings"), "vec_id", "vec_id", "embedding")
    return found.select("query_id", "row_id", F.round("distance", 6).alias("distance"))


@query("J6", _PAIRS + """ select round(max(distance), 6) as max_distance, round(avg(distance), 6) as mean_distance,
    avg((a = b)::int) as label_agreement, max(distance) < 0.01 and avg((a = b)::int) > 0.99 as trustworthy from best""")
def nearest_row_report(spark, sf):
    queries, rows = drifted(spark, sf), views.table(spark, sf, "embeddings")
    found = neighbours.nearest(queries, rows, "vec_id", "vec_id", "embedding")
    report = neighbours.match_report(found, queries, rows, "vec_id", "vec_id", "label")
    return report.select(F.round("max_distance", 6).alias("max_distance"),
                         F.round("mean_distance", 6).alias("mean_distance"), "label_agreement", "trustworthy")
