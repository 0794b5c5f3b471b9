"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.store import dropped, stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v); root is the smallest node of its component.

    Loops, repeated edges and nulls are allowed and mean nothing. Each round is two grouped minima and
    two equi joins; a hub's edges lie on the side of a join that Spark may split, as the other side
    has one row a node. The loop ends when a round leaves the edges as they were: all are then stars.
    """
    edges = edges.where("u is not null and v is not null and u != v")
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        digest = _digest(new)
        dropped(now)
        now = new
        if digest == seen:
            break
        seen = digest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
