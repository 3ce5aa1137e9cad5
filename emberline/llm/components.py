"""Connected components by alternating large-star and small-star joins.

Labels and links stay in distributed tables; each round is cut by a written table,
and the driver sees a row count and a checksum only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.scratch import drop, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("k"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("k"), F.col("u").alias("o")))
    least = stage(both.groupBy("k").agg(F.min("o").alias("m")).where("m < k"), "mins")
    joined = edges.join(least, edges.v == least.k, "left")
    out = stage(joined.select("u", F.least("v", F.coalesce("m", "v")).alias("v")).distinct(), "large")
    drop(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = stage(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "mins")
    moved = edges.join(least, edges.u == least.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "small")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node reachable.

    Null ends and self links are ignored, repeated links count once, and an empty
    table gives an empty result.  A root itself appears as (root, root).
    """
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(clean, "links")
    signature = _signature(now)
    while signature[0]:
        wide = _large_star(now)
        new = _small_star(wide)
        drop(now), drop(wide)
        now, before, signature = new, signature, _signature(new)
        if signature == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
