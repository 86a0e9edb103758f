"""Connected components over a table of links, by alternating large and small stars.

Links stay in Spark: every round is two aggregations and joins over the link table, written to the shared folder.
Minima are aggregated before the shuffle, so a centre with many neighbours is one small row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, keep_smaller: bool) -> DataFrame:
    """Link each neighbour ``b`` of ``a`` to the least of a's neighbourhood; only larger ones unless ``keep_smaller``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("c", "m").alias("m"))
    joined = pairs.join(least, F.col("a") == F.col("c"))
    if keep_smaller:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root), root being the least node reachable. Nodes without a link do not appear.

    Self links, repeated links and either direction are fine; an empty table gives an empty one.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_star(both, False))
        links = cut(_star(large, True))
        new = _state(links)
        if new == state:
            break
        state = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
