"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagscope.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (bigint) for every node of the links ``u``, ``v`` between two different nodes.

    Each round points every node at the first of itself and its neighbours, in the order of a hash of the
    node, and contracts the links to the nodes pointed at. The random order removes a constant share of
    the remaining nodes in a round, long chains included, so rounds grow with the logarithm of the nodes.
    Tables are written between rounds; the driver only asks whether links are left.
    """
    edges = materialize(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    rooted: DataFrame | None = None
    while rooted is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("to")))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("to"))
        to = materialize(both.groupBy("u").agg(first.alias("m")).select(F.col("u").alias("node"), F.least("m", own)["to"].alias("to")))
        left = to.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = to.select(F.col("node").alias("v"), F.col("to").alias("b"))
        contracted = edges.join(left, "u").join(right, "v").where("a <> b")
        edges = materialize(contracted.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if rooted is None:
            rooted = to.withColumnRenamed("to", "root")
        else:
            step = to.withColumnRenamed("node", "root")
            rooted = materialize(rooted.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return rooted
