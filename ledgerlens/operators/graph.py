"""Connected components of links inside a key, in as many rounds as the logarithm of the largest component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """From ``links(*keys, a, b)`` to (*keys, node, component); nodes are integers, links go either way.

    Each round every node joins the neighbour of least hash, if that is less than its own, and all links move on to
    the nodes joined. Hashes change with the round, so on any shape a fixed share of the nodes is expected to go. A
    component is named by the node that is left.
    """
    turned = links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    edges = cut(links.select(*keys, "a", "b").unionByName(turned).where("a <> b").distinct())
    labels = links.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    rounds = 0
    while not edges.isEmpty():
        rank = lambda c, salt=rounds: F.xxhash64(F.lit(salt), c)
        least = edges.groupBy(*keys, "a").agg(F.min(F.struct(rank("b").alias("h"), "b")).alias("m"))
        joined = F.when(F.col("m.h") < rank("a"), F.col("m.b")).otherwise(F.col("a"))
        steps = cut(least.select(*keys, F.col("a").alias("from"), joined.alias("to")))
        first = steps.select(*keys, F.col("from").alias("a"), F.col("to").alias("x"))
        second = steps.select(*keys, F.col("from").alias("b"), F.col("to").alias("y"))
        moved = edges.join(first, [*keys, "a"]).join(second, [*keys, "b"]).select(*keys, F.col("x").alias("a"), F.col("y").alias("b"))
        edges = cut(moved.where("a <> b").distinct())
        onward = steps.withColumnRenamed("from", "component")
        labels = cut(labels.join(onward, [*keys, "component"], "left").select(*keys, "node", F.coalesce("to", "component").alias("component")))
        rounds += 1
    return labels
