"""Connected components by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import smallest_of_group, stored, with_salts


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long) -> ``node, component`` for every node with an edge; component is the smallest node reachable.

    A round hangs every neighbour above a node under the smallest of its neighbourhood (large star), then every
    neighbour below it likewise (small star); the rounds end when the edges are stars around the components'
    smallest nodes.  Each round is written to the shared folder, so lineage stays short.  The centre of
    a large star is salted, so no task holds its component.
    """

    def around(rows: DataFrame) -> DataFrame:
        """``u, v`` with the smallest v of each u as m."""
        salted, winners = smallest_of_group(rows, ["u"], "v", salts=16)
        return salted.join(with_salts(winners, 16).withColumnRenamed("smallest", "m"), ["salt", "u"]).select("u", "v", "m")

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = around(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = around(large).select(F.expr("explode(array(struct(u, m), struct(v AS u, m)))").alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        now = stored(small, "cc-edges", instead_of=now)
        # Stars: no node hangs under two others, nor under one that hangs itself.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("hangs")))
        if ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least")).filter("hangs > 1 OR hangs > least").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
