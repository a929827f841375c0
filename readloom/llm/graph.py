"""Connected components by alternating large-star and small-star steps; every step is a join and a pre-aggregated minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, label), label the smallest id of the component; ids without an edge to another id don't occur."""
    edges = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        # done when the edges are stars: every u has one v, and no v is a u
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        roles = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if roles.filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept(small.filter("u <> v").distinct(), "edges")
