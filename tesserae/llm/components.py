"""Connected components of a distributed graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts


def connected_components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, component) for each node that an edge (a, b) touches; component is the smallest node it reaches.

    Each round points every node at the smallest neighbour it or its smaller
    neighbours know, so chains halve and hubs are never gathered: a hub's
    edges stay rows, joined with its one-row minimum. Rounds end when the
    edges are stars around the smallest node of each component. Self-loops and
    edges with a null end are ignored,
    repeated edges count once; no edges give no rows.
    """
    real = edges.filter("a is not null and b is not null and a <> b")
    e = cuts.write(real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows, stars = _shape(e)
    while not stars:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cuts.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), rows)
        large = cuts.write(e.join(least, "v").select("u", F.col("m").alias("v")).distinct(), rows)
        least2 = cuts.write(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cuts.write(small.unionByName(least2.withColumnRenamed("m", "v")).distinct(), rows)
        for old in (e, least, large, least2):
            cuts.drop(old)
        e = new
        rows, stars = _shape(e)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _shape(e: DataFrame) -> tuple[int, bool]:
    """Number of the edges (u, v), u > v, and whether each u has one v that is no u itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    rows, bent = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return rows, not bent
