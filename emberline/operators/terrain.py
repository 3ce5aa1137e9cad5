"""Terrain gradient, ravines and the wind field."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def _beside(df: DataFrame, value: str, along: str, across: str) -> DataFrame:
    w = Window.partitionBy(across).orderBy(along)
    return df.withColumns({f"{value}_{along}0": F.lag(value).over(w), f"{value}_{along}1": F.lead(value).over(w)})


def neighbours(cells: DataFrame, value: str = "elev") -> DataFrame:
    """cells (x, y) with the values before and after along both axes, null at edges."""
    return _beside(_beside(cells, value, "x", "y"), value, "y", "x")


def gradient(cells: DataFrame, value: str = "elev", spacing: float = 1.0) -> DataFrame:
    """Adds dx, dy, slope, aspect: central differences inside, one-sided at edges."""
    def d(axis):
        before, after, here = F.col(f"{value}_{axis}0"), F.col(f"{value}_{axis}1"), F.col(value)
        inner = (after - before) / 2
        return F.coalesce(inner, after - here, here - before, F.lit(0.0)) / F.lit(spacing)

    out = neighbours(cells, value).withColumns({"dx": d("x"), "dy": d("y")})
    return out.withColumns({"slope": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), "aspect": F.atan2("dy", "dx")})


def ravine(value: str = "elev", threshold: float = 5.0):
    """Condition on cells with neighbours: one is much lower and one much higher; never at edges."""
    diffs = [F.col(f"{value}_{c}") - F.col(value) for c in ("x0", "x1", "y0", "y1")]
    inside = diffs[0].isNotNull() & diffs[1].isNotNull() & diffs[2].isNotNull() & diffs[3].isNotNull()
    any_of = lambda test: test(diffs[0]) | test(diffs[1]) | test(diffs[2]) | test(diffs[3])
    return F.coalesce(inside & any_of(lambda d: d < -threshold) & any_of(lambda d: d > threshold), F.lit(False))


def uniform_wind(cells: DataFrame, direction: float, speed: float) -> DataFrame:
    return cells.select("*", F.lit(direction).alias("dir"), F.lit(speed).alias("speed"), F.lit(speed * math.cos(direction)).alias("u"), F.lit(speed * math.sin(direction)).alias("v"))


def terrain_wind(cells: DataFrame, direction: float = 0.0, speed: float = 0.5, effect: float = 0.5, threshold: float = 5.0, amplification: float = 1.5) -> DataFrame:
    """(x, y, elev, slope, aspect, ravine, dir, speed, u, v): base wind bent and changed by the terrain.

    Directions are radians from east, slopes under 0.05 leave the wind alone.
    """
    g = gradient(cells).withColumn("ravine", ravine(threshold=threshold))
    turn = F.lit(2 * math.pi)
    raw = F.pmod(F.abs(F.lit(direction) - F.col("aspect")), turn)
    apart = F.when(raw > math.pi, turn - raw).otherwise(raw)
    share = F.sin(apart) * F.lit(effect)
    bent = F.pmod((F.lit(1.0) - share) * F.lit(direction) + share * F.col("aspect"), turn)
    steep = F.col("slope") >= 0.05
    out = g.withColumn("dir", F.when(steep, bent).otherwise(F.lit(direction)))
    change = F.lit(1.0) - F.cos(F.col("dir") - F.col("aspect")) * F.col("slope") * F.lit(effect)
    changed = F.lit(speed) * F.greatest(F.lit(0.5), F.least(F.lit(1.5), change)) * F.when(F.col("ravine"), F.lit(amplification)).otherwise(F.lit(1.0))
    out = out.withColumn("speed", F.when(steep, changed).otherwise(F.lit(speed)))
    return out.select("x", "y", "elev", "slope", "aspect", "ravine", "dir", "speed", (F.col("speed") * F.cos("dir")).alias("u"), (F.col("speed") * F.sin("dir")).alias("v"))


def wind_facts(wind: DataFrame) -> DataFrame:
    return wind.agg(F.count("*").alias("cells"), F.count_if("ravine").alias("ravines"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.min("dir").alias("min_dir"), F.max("dir").alias("max_dir"))
