"""Connected components of a table of edges, round by round on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import settle


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge table (a long, b long); root is the smallest node of its component.

    Rounds of large-star and small-star: each node hands its neighbours on to
    the smallest of them, which needs a minimum per node (combined on the map
    side) and a join back, and about log n rounds. Each round is written to
    the shared folder, which cuts the lineage. A node whose only edge leads to
    itself is a component of one; no edges give no rows.
    """
    given = settle(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    now = given.where("low <> high")
    state = None
    for _ in range(most_rounds):
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).union(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()
        large = large.where("low <> high")
        small_least = large.groupBy(F.col("high").alias("u")).agg(F.min("low").alias("m"))
        small = large.join(small_least, large.high == small_least.u).select(
            F.col("m"), F.explode(F.array("low", "high")).alias("v"))
        now = settle(small.where("m <> v").select(F.col("m").alias("low"), F.col("v").alias("high")).distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = F.col("low").alias("root")
    found = now.select(F.col("high").alias("node"), own).union(now.select(F.col("low").alias("node"), own)).distinct()
    alone = given.where("low = high").select(F.col("low").alias("node"), own).join(found, "node", "left_anti")
    return found.union(alone)
