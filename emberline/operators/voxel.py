"""Voxel grids: fuel from density, moisture, vertical connection and ignition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from emberline.functions import fire
from emberline.functions.rng import uniform
from emberline.operators.raster import min_max
from emberline.schema import BURNING, UNBURNED


def fuel_grid(voxels: DataFrame, pad: DataFrame, most: float = 10.0) -> DataFrame:
    """voxels (x, y, z) with fuel in [0, 1] from plant area density (gx, gy, bin, pad); empty voxels 0."""
    known = pad.select(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("bin").cast("int").alias("z"), (F.col("pad") / most).alias("fuel"))
    return voxels.join(known, ["x", "y", "z"], "left").withColumn("fuel", F.coalesce("fuel", F.lit(0.0)))


def with_connectivity(voxels: DataFrame, height: float = 2.0) -> DataFrame:
    """Adds conn_up, the connection to the voxel above; null in the top layer."""
    above = F.lead("fuel").over(Window.partitionBy("x", "y").orderBy("z"))
    return voxels.withColumn("conn_up", fire.connectivity(F.col("fuel"), above, height))


def moisture_field(cells: DataFrame, values: DataFrame, default: float = 0.3, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """cells (x, y) with moisture scaled from values (x, y, value); cells without one get the default."""
    scaled = min_max(values, "value", low, high, default)
    return cells.join(scaled, ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(default)).alias("moisture"))


def fuel_facts(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("z").agg(F.min("fuel").alias("min_fuel"), F.max("fuel").alias("max_fuel"), F.avg("fuel").alias("mean_fuel"))


def ignition_points(cells: DataFrame, method: str, width: int, height: int, points: list[tuple[int, int, int]] | None = None, k: int = 1, seed: int = 42) -> DataFrame:
    """(x, y, z) to ignite: centre, corner, random, edge, multiple or coordinates; outside ones are left out."""
    spark = cells.sparkSession
    if method == "random" or method == "multiple":
        n = F.col("id")
        return spark.range(k).select(F.floor(uniform(seed, "ix", n) * width).cast("int").alias("x"), F.floor(uniform(seed, "iy", n) * height).cast("int").alias("y"), F.lit(0).alias("z"))
    if method == "edge":
        rim = cells.where((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)).select("x", "y").distinct()
        return rim.orderBy(uniform(seed, "rim", F.col("x"), F.col("y")), "x", "y").limit(k).withColumn("z", F.lit(0))
    chosen = {"center": [(width // 2, height // 2, 0)], "corner": [(0, 0, 0)]}.get(method, points or [])
    return spark.createDataFrame(chosen, "x int, y int, z int").where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & (F.col("z") >= 0))


def ignite(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """voxels with state: burning at the points, unburned elsewhere; points off the grid do nothing."""
    lit = points.distinct().withColumn("lit", F.lit(True))
    return voxels.join(lit, ["x", "y", "z"], "left").withColumn("state", F.when(F.col("lit"), BURNING).otherwise(UNBURNED)).drop("lit")
