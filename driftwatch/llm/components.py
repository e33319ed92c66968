"""Connected components of a graph given as an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.storage import stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (a, b); component is the smallest id that can be reached.

    Each round maps every node to its smallest neighbour and contracts the edges, until none is left; the maps are then
    followed one after the other. Groups are reduced by partial aggregates; a node with very many edges meets only a
    small map in the joins, which adaptive execution splits. All steps are written to the shared folder. Repeated edges,
    loops and an empty table are allowed; edges with a null end are ignored.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = stage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
                   .withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        smallest = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "smallest")
        ends = smallest.select("a", F.col("to").alias("ta"))
        other = smallest.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        edges = stage(edges.join(ends, "a").join(other, "b").where("ta <> tb")
                      .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        labels = stage(labels.join(smallest.withColumnRenamed("a", "component"), "component", "left")
                       .select("id", F.coalesce("to", "component").alias("component")), "labels")
    return labels
