"""Connected components of a graph given as an edge table, by minimum labels and pointer jumping.

Every step is a join or a pre-aggregated group-by of plain tables that lie in the shared folder, so that Spark can split
a hub's rows and a lost executor costs one step. No edges or labels come to the driver; only a count does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm._common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any direction, repeats and loops allowed. Returns (node, root): the smallest node reachable."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        # the smallest label among the neighbours, which have had the smallest of theirs
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        told = materialize(labels.join(heard, "node", "left").select("node", "root", F.least("root", F.coalesce("heard", "root")).alias("low")), "told")
        # the root of a lower label is lower still: jump
        jump = told.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = materialize(told.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("root"), (F.coalesce("lower", "low") < F.col("root")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        forget(told, labels)
        labels = new.select("node", "root")
        if not moved:
            forget(both)
            return labels


def contracted_components(edges: DataFrame) -> DataFrame:
    """As components(), for graphs with many links in each group: every node first merges with its smallest neighbour, which leaves
    few links, and only those are iterated over."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    low = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("low")), "low")
    one = both.where("a < b").join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").select("x", "b")
    rest = one.join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    roots = components(materialize(rest, "rest")).select(F.col("node").alias("low"), "root")
    return low.join(roots, "low", "left").select("node", F.coalesce("root", "low").alias("root"))
