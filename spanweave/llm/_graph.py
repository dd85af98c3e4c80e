"""Connected components of an edge table, by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm._store import forget, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node reachable.

    Each step hangs neighbours under the smallest node seen, through grouped
    minima and joins whose hot keys the adaptive planner can split; nothing is
    gathered per node. The rounds grow with the logarithm of a component's
    size. Null ends and self-links are ignored; no edges give no rows.
    """
    current = stored(edges.where("a is not null and b is not null and a <> b")
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("k"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = (large.join(least, F.col("a") == F.col("k")).select("a", "b", "m")
                 .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        after = stored(small, "edges")
        state = after.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(current)
        current = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
