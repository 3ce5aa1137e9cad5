"""Spatial joins by buckets: nearest ground point, inverse distance and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.operators import quadtree
from emberline.scratch import stage


def _asked(df: DataFrame, x: str, y: str, size: float, reach: int = 1) -> DataFrame:
    steps = range(-reach, reach + 1)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
    spread = df.select("*", F.inline(around))
    return spread.withColumns({"bx": F.floor(F.col(x) / size) + F.col("i"), "by": F.floor(F.col(y) / size) + F.col("j")}).drop("i", "j")


def _placed(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"bx": F.floor(F.col(x) / size), "by": F.floor(F.col(y) / size)})


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (x, y, ...) and right (gx, gy, gz) at most radius apart, with their distance."""
    d = F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2)
    met = _asked(left, "x", "y", radius).join(_placed(right, "gx", "gy", radius), ["bx", "by"])
    return met.withColumn("d", d).where(F.col("d") <= radius).drop("bx", "by")


def normalise_heights(points: DataFrame, ground: DataFrame) -> DataFrame:
    """points (x, y, z, ...) with hag, the height over the nearest ground point (x, y, z).

    See quadtree.nearest: the ground is cut into leaves of few points, so dense and thin
    ground cost a point the same.  Of ground points at one place, and of equally near ones,
    the lowest counts.  hag is null without ground and for points whose x or y is not a
    number; a column of that name is replaced.
    """
    points = points.drop("hag")
    low = stage(ground.groupBy(F.col("x").alias("gx"), F.col("y").alias("gy")).agg(F.min("z").alias("gz")), "ground")
    numbered = stage(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    sound = F.lit(True)
    for c in ("x", "y"):
        sound = sound & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    near = quadtree.nearest(numbered.where(sound).select("_row", "x", "y"), low).select("_row", F.col("near.gz").alias("_ground"))
    return numbered.join(near, "_row", "left").withColumn("hag", F.col("z") - F.col("_ground")).drop("_ground", "_row")


def terrain_model(ground: DataFrame, cells: DataFrame, resolution: float = 5.0, radius: float = 22.0, power: float = 2.0) -> DataFrame:
    """(gx, gy, elev): inverse distance means of ground points around the centres of cells (gx, gy)."""
    centres = cells.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), ((F.col("gx") + 0.5) * resolution).alias("x"), ((F.col("gy") + 0.5) * resolution).alias("y"))
    met = within(centres, ground.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz")), radius)
    w = F.lit(1.0) / F.pow(F.greatest("d", F.lit(1e-9)), F.lit(power))
    return met.groupBy(F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg((F.sum(w * F.col("gz")) / F.sum(w)).alias("elev"))


def over_terrain(points: DataFrame, model: DataFrame, resolution: float = 5.0) -> DataFrame:
    """points with hag over the pixel of a terrain model (gx, gy, elev) that they lie in."""
    placed = points.withColumns({"gx": F.floor(F.col("x") / resolution).cast("int"), "gy": F.floor(F.col("y") / resolution).cast("int")})
    return placed.join(model, ["gx", "gy"], "left").withColumn("hag", F.col("z") - F.col("elev")).drop("gx", "gy", "elev")


#: intervals that to_edges hands to every task, at most
MAX_EDGES = 1 << 16


def to_edges(values: DataFrame, edges: DataFrame, z: str = "z") -> DataFrame:
    """values with the bin (low, high) of a table of uneven intervals that do not overlap; others are left out.

    The intervals travel as one sorted array that each value is looked up in by halving.
    """
    known = edges.select(F.col("low").cast("double"), F.col("high").cast("double")).where("low < high").distinct().orderBy("low").limit(MAX_EDGES + 1).collect()
    if len(known) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} intervals")
    if any(a.high > b.low for a, b in zip(known, known[1:], strict=False)):
        raise ValueError("intervals overlap")
    one = edges.sparkSession.createDataFrame([([tuple(e) for e in known],)], "_edges array<struct<low:double,high:double>>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(known).bit_length())))])
    further = lambda at, step: F.when((at + step <= len(known)) & (F.get(F.col("_edges"), at + step - 1)["low"] <= F.col(z)), at + step).otherwise(at)
    bin_of = F.get(F.col("_edges"), F.aggregate(steps, F.lit(0), further) - 1)
    found = values.join(F.broadcast(one)).withColumn("_bin", bin_of)  # one row
    return found.where(F.col(z) < F.col("_bin.high")).select(*values.columns, "_bin.low", "_bin.high")


def overlapping(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(box_id, tile_x, tile_y) of boxes and tiles (x_min, x_max, y_min, y_max) that touch.

    Boxes are listed under all tiles of one size that they can touch, so this is an equality join.
    """
    side = tiles.agg(F.max(F.col("x_max") - F.col("x_min")).alias("w"), F.max(F.col("y_max") - F.col("y_min")).alias("h"))  # one row
    span = lambda a, b, s: F.sequence(F.floor(F.col(a) / F.col(s)).cast("int"), F.floor(F.col(b) / F.col(s)).cast("int"))
    listed = boxes.join(F.broadcast(side)).withColumn("kx", F.explode(span("x_min", "x_max", "w"))).withColumn("ky", F.explode(span("y_min", "y_max", "h")))
    named = tiles.join(F.broadcast(side)).withColumn("kx", F.explode(span("x_min", "x_max", "w"))).withColumn("ky", F.explode(span("y_min", "y_max", "h")))
    named = named.select("tile_x", "tile_y", "kx", "ky", *[F.col(c).alias(f"t_{c}") for c in ("x_min", "x_max", "y_min", "y_max")])
    touch = (F.col("x_min") < F.col("t_x_max")) & (F.col("x_max") > F.col("t_x_min")) & (F.col("y_min") < F.col("t_y_max")) & (F.col("y_max") > F.col("t_y_min"))
    return listed.join(named, ["kx", "ky"]).where(touch).select("box_id", "tile_x", "tile_y").distinct()
