"""Filters of height artefacts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from emberline.functions.rng import uniform


def _facts(points: DataFrame) -> DataFrame:
    """One row: number of points, negatives, mean, population deviation and bounding box."""
    return points.agg(
        F.count("*").alias("n"), F.count_if(F.col("z") < 0).alias("negatives"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )


def _plausible(min_valid: float, z_score: float):
    usual = F.abs((F.col("z") - F.col("mean")) / F.col("std")) <= z_score
    return F.when(F.col("std") > 0, (F.col("z") >= min_valid) | usual).otherwise(F.col("z") >= min_valid)


def filter_artefacts(points: DataFrame, method: str = "statistical", min_valid: float = -1.0, z_score: float = 2.5, slope: float = 45.0) -> DataFrame:
    """Points without implausible heights; without negative heights nothing is filtered.

    simple keeps z >= 0; statistical keeps what is above min_valid or within z_score
    deviations; local drops negative points that differ too much from a neighbour;
    combined does both; any other name keeps z >= min_valid.
    """
    columns = points.columns
    if method == "simple":
        return points.where(F.col("z") >= 0)
    joined = points.join(F.broadcast(_facts(points)))  # one row
    if method == "statistical":
        keep = _plausible(min_valid, z_score)
    elif method in ("local", "combined"):
        joined = _with_jumps(joined, slope)
        keep = ~((F.col("z") < 0) & F.coalesce(F.col("jump"), F.lit(False)))
        if method == "combined":
            keep &= _plausible(min_valid, z_score)
    else:
        keep = F.col("z") >= min_valid
    return joined.where((F.col("negatives") == 0) | keep).select(columns)


def search_radius():
    """Three times the mean spacing of the points."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return F.lit(3.0) / F.sqrt(F.col("n") / area)


def _with_jumps(joined: DataFrame, slope: float) -> DataFrame:
    """Adds jump: a neighbour within the radius differs by more than the slope allows.

    Neighbours meet in square buckets as wide as the radius: each point stands in its own
    bucket, each negative point asks in nine.  For each bucket only the extremes of a
    negative point's neighbours are kept, so nothing is collected.
    """
    keyed = joined.withColumn("r", search_radius())
    keyed = keyed.withColumns({"bx": F.floor(F.col("x") / F.col("r")), "by": F.floor(F.col("y") / F.col("r"))})
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asks = keyed.where("z < 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "bx", "by", "r").distinct()
    asks = asks.withColumn("o", F.explode(around)).select("px", "py", "pz", "r", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
    near = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= F.col("r") ** 2
    met = asks.join(keyed.select("x", "y", "z", "bx", "by"), ["bx", "by"]).where(near)
    found = met.groupBy("px", "py", "pz", "r").agg(F.count("*").alias("m"), F.max(F.abs(F.col("z") - F.col("pz"))).alias("most"))
    jumps = found.select("px", "py", "pz", ((F.col("m") > 1) & (F.col("most") > F.col("r") * F.lit(math.tan(math.radians(slope))))).alias("jump"))
    return keyed.join(jumps, (keyed.x == jumps.px) & (keyed.y == jumps.py) & (keyed.z == jumps.pz), "left")


def drop_negative(points: DataFrame) -> DataFrame:
    return points.where(F.col("z") >= 0)


def low_canopy(points: DataFrame) -> DataFrame:
    """(max_z, negatives, low_canopy) of a cloud."""
    out = points.agg(F.max("z").alias("max_z"), F.count_if(F.col("z") < 0).alias("negatives"))
    return out.withColumn("low_canopy", (F.col("max_z") < 1) & (F.col("negatives") == 0))


def height_range(points: DataFrame, classes: tuple[int, ...] = (3, 4, 5), low: float = 0.0, high: float = 80.0) -> DataFrame:
    return points.where(F.col("classification").isin(list(classes)) & F.col("z").between(low, high))


def top_random(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows by the smallest draw of their key, ties by the key; the same rows on every run."""
    return df.orderBy(uniform(seed, "top", *[F.col(k) for k in key]), *key).limit(n)


def recorded_steps(snaps: DataFrame, every: int) -> DataFrame:
    """Rows of every n-th step, and of the last one."""
    last = snaps.agg(F.max("step").alias("_last"))  # one row
    return snaps.join(F.broadcast(last)).where((F.col("step") % every == 0) | (F.col("step") == F.col("_last"))).drop("_last")


def with_companions(tables: DataFrame, files: DataFrame, folder: str = "nrd_rasters", suffix: str = ".tif") -> DataFrame:
    """tables (path) beside which there is a folder with one file of that kind at least; files: (path)."""
    there = files.where(F.lower("path").endswith(suffix)).select(F.regexp_extract("path", rf"^(.*)/{folder}/[^/]+$", 1).alias("_base")).where("_base <> ''").distinct()
    return tables.withColumn("_base", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).join(there, "_base", "left_semi").drop("_base")


def outcomes(runs: DataFrame, *by: str) -> DataFrame:
    """(by, total, succeeded, failed) of rows with a flag ok; a null flag is a failure."""
    ok = F.coalesce("ok", F.lit(False))
    return runs.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
