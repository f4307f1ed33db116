"""Connected components of a distributed edge table, without the driver seeing links.

Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is an
aggregation to the least neighbour, and one join with it between plain shuffled tables,
which adaptive execution splits where one centre holds many rows; no step gathers a node's
neighbours. Each round is cut off by a write to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link; root is the component's least node, itself without a row.

    Null endpoints, loops and repeated links are ignored. No links: an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    e = stored(e.distinct())
    for _ in range(rounds):
        # large star: a node's greater neighbours go to its least neighbour, or itself
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        large = e.join(low.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = stored(large.distinct())
        # small star: its lesser neighbours do, too
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        lesser = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        was, e = e, stored(lesser.unionByName(low.withColumnRenamed("m", "b")).distinct())
        dropped(was, large)
        middle = e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi")
        several = e.groupBy("a").count().where("count > 1")
        if middle.isEmpty() and several.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components: not settled after {rounds} rounds")
