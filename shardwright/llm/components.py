"""Connected components of an edge table, distributed (large-star and small-star rounds until nothing changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm.shared import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of the component.

    Loops, repeated edges and either direction are fine; edges with a null end are ignored; no edges, no rows. Each
    round is written to the shared folder, so the plan stays short and a lost executor costs one round at most. Hubs
    don't gather in a task: a node's least neighbour is a partial aggregate, and the join back is a plain equi-join
    that adaptive execution can split."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = written(e.where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        # large star: every larger neighbour moves to the least of the neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        old, e = e, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(e, "large")
        forget(old)
        # small star: a node and its smaller neighbours move to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, e = e, written(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        forget(old)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
