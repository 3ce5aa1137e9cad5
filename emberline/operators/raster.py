"""Rasters as long tables: density, scaling, resampling, merging and smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from emberline.schema import BURNED, BURNING
from emberline.sources.rasters import to_pixel


def frame(points: DataFrame, resolution: float = 5.0, least: int = 100, pad: float = 0.02) -> DataFrame:
    """One row: padded extent, raster size and effective resolution."""
    box = points.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    wide, high = (F.col("b") - F.col("a")), (F.col("d") - F.col("c"))
    box = box.select((F.col("a") - wide * pad).alias("x0"), (F.col("d") + high * pad).alias("top"), (wide * (1 + 2 * pad)).alias("w"), (high * (1 + 2 * pad)).alias("h"))
    width, height = (F.greatest(F.lit(least), F.ceil(F.col(c) / resolution)).cast("int") for c in "wh")
    return box.select("x0", "top", width.alias("width"), height.alias("height"), (F.col("w") / width).alias("dx"), (F.col("h") / height).alias("dy"))


def density(points: DataFrame, resolution: float = 5.0, least: int = 100) -> DataFrame:
    """(row, col, n) of occupied pixels."""
    joined = points.join(F.broadcast(frame(points, resolution, least)))  # one row
    row, _ = to_pixel(F.col("x"), F.col("y"), F.col("x0"), F.col("top"), F.col("dy"), F.col("width"), F.col("height"))
    _, col = to_pixel(F.col("x"), F.col("y"), F.col("x0"), F.col("top"), F.col("dx"), F.col("width"), F.col("height"))
    return joined.groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


def to_bytes(voxels: DataFrame, value: str = "n", by: str = "bin") -> DataFrame:
    """Adds byte: value scaled by the maximum of its band to 0..255, truncated."""
    most = voxels.groupBy(by).agg(F.max(value).alias("most"))  # as many rows as bands
    return voxels.join(F.broadcast(most), by).withColumn("byte", (F.col(value) / F.col("most") * 255).cast("int")).drop("most")


def min_max(df: DataFrame, value: str, low: float, high: float, constant: float, by: list[str] | None = None) -> DataFrame:
    """value scaled to [low, high] within groups (or overall); a constant group gets `constant`."""
    by = by or []
    facts = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b")) if by else df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    joined = df.join(facts, by) if by else df.join(F.broadcast(facts))  # overall: one row
    scaled = F.lit(low) + (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * F.lit(high - low)
    return joined.withColumn(value, F.when(F.col("_b") > F.col("_a"), scaled).otherwise(F.lit(constant))).drop("_a", "_b")


def bilinear(raster: DataFrame, width: int, height: int, new_width: int, new_height: int, corners: bool = False) -> DataFrame:
    """(x, y, value) of a raster (x, y, value) resized by its four nearest pixels.

    Pixel centres are mapped with a half-pixel shift and edges repeat; with corners=True
    the corner pixels are aligned.
    """
    spark = raster.sparkSession
    out = spark.range(new_width * new_height).select((F.col("id") % new_width).cast("int").alias("nx"), F.floor(F.col("id") / new_width).cast("int").alias("ny"))

    def source(c, n, m):
        if corners:
            return F.col(c) * F.lit((n - 1) / max(m - 1, 1))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(c) + 0.5) * F.lit(n / m) - 0.5))

    out = out.withColumns({"sx": source("nx", width, new_width), "sy": source("ny", height, new_height)})
    out = out.withColumns({"x0": F.floor("sx").cast("int"), "y0": F.floor("sy").cast("int")})
    fx, fy = F.col("sx") - F.col("x0"), F.col("sy") - F.col("y0")
    step = lambda c, n: F.least(F.col(c) + 1, F.lit(n - 1))
    corner = lambda x, y, w: F.struct(x.alias("x"), y.alias("y"), w.alias("w"))
    four = F.array(corner(F.col("x0"), F.col("y0"), (1 - fx) * (1 - fy)), corner(step("x0", width), F.col("y0"), fx * (1 - fy)), corner(F.col("x0"), step("y0", height), (1 - fx) * fy), corner(step("x0", width), step("y0", height), fx * fy))
    parts = out.select("nx", "ny", F.inline(four)).where("w > 0")
    return parts.join(raster, ["x", "y"]).groupBy(F.col("nx").alias("x"), F.col("ny").alias("y")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def resize(raster: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """As bilinear, after smoothing along each axis that shrinks, by half of what it shrinks beyond one."""
    for axis, size, new in (("x", width, new_width), ("y", height, new_height)):
        if size > new:
            raster = smooth_axis(raster, axis, size, (size / new - 1) / 2, mirror=True)
    return bilinear(raster, width, height, new_width, new_height)


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, ...): level k holds every 2^k-th cell."""
    scale = F.pow(F.lit(2), F.col("level")).cast("int")
    out = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_s", scale)
    out = out.where((F.col("x") % F.col("_s") == 0) & (F.col("y") % F.col("_s") == 0))
    return out.withColumns({"x": F.floor(F.col("x") / F.col("_s")).cast("int"), "y": F.floor(F.col("y") / F.col("_s")).cast("int")}).drop("_s")


def priority(state):
    """Burning before burned before unburned."""
    return F.when(state == BURNING, 2).when(state == BURNED, 1).otherwise(0)


def from_priority(p):
    return F.when(p == 2, BURNING).when(p == 1, BURNED).otherwise(0)


def block_priority(cells: DataFrame, factor: int, width: int, height: int) -> DataFrame:
    """(x, y, state) of whole blocks of factor x factor cells, by priority."""
    inside = (F.col("x") < width // factor * factor) & (F.col("y") < height // factor * factor)
    blocks = cells.where(inside).groupBy(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y"))
    return blocks.agg(from_priority(F.max(priority(F.col("state")))).alias("state"))


def merge_priority(parts: DataFrame, key: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Overlapping tiles to one state for each voxel, by priority."""
    return parts.groupBy(*key).agg(from_priority(F.max(priority(F.col("state")))).alias("state"))


def merge_last(parts: DataFrame, order: str, key: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Overlapping tiles where the last in order wins."""
    value = [c for c in parts.columns if c not in (*key, order)]
    return parts.groupBy(*key).agg(F.max_by(F.struct(*value), order).alias("v")).select(*key, "v.*")


def blend(parts: DataFrame, overlap: int, key: tuple[str, ...] = ("x", "y"), value: str = "value", edge: str = "edge") -> DataFrame:
    """Overlapping tiles weighted by the distance to their edge, up to the overlap."""
    weight = F.least(F.lit(1.0), (F.col(edge) + 1) / F.lit(overlap + 1))
    return parts.groupBy(*key).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias(value))


def smooth(cells: DataFrame, sigma: float, width: int, height: int, value: str = "value", truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing by two passes of one-dimensional sums, edges cut off."""
    for axis, size in (("x", width), ("y", height)):
        cells = smooth_axis(cells, axis, size, sigma, value, truncate)
    return cells


def smooth_axis(cells: DataFrame, axis: str, size: int, sigma: float, value: str = "value", truncate: float = 4.0, mirror: bool = False) -> DataFrame:
    """One pass; what lies beyond an edge is nothing, or with `mirror` what lies as far before it."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)] if sigma > 0 else [1.0]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(raw)).alias("w")) for d, w in zip(range(-reach, reach + 1), raw, strict=True)])
    if mirror and size > 1:  # every pixel asks for what lies around it
        period = 2 * (size - 1)
        at = F.pmod(F.col(axis) + F.col("d"), F.lit(period))
        asked = cells.select("x", "y", F.inline(kernel)).withColumn("_at", F.when(at < size, at).otherwise(F.lit(period) - at))
        other = "y" if axis == "x" else "x"
        known = cells.select(F.col(axis).alias("_at"), F.col(other), F.col(value))
        return asked.join(known, ["_at", other]).groupBy("x", "y").agg(F.sum(F.col("w") * F.col(value)).alias(value))
    spread = cells.select("x", "y", value, F.inline(kernel)).withColumn(axis, F.col(axis) + F.col("d")).where(F.col(axis).between(0, size - 1))
    return spread.groupBy("x", "y").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def dilate(cells: DataFrame, width: int, height: int, times: int = 1) -> DataFrame:
    """Cells (x, y) with their four neighbours, repeatedly."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    for _ in range(times):
        cells = cells.select("x", "y", F.inline(steps)).select((F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).distinct()
        cells = cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return cells


def statistics(raster: DataFrame, value: str = "value") -> DataFrame:
    return raster.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def every_nth(cells: DataFrame, n: int) -> DataFrame:
    return cells.where((F.col("x") % n == 0) & (F.col("y") % n == 0))




def write_through(levels: DataFrame, changes: DataFrame) -> DataFrame:
    """levels (level, x, y, state) of a pyramid after changes (x, y, state) of its finest level.

    A coarser cell takes the state of the last of its changed children, by y, then x.
    """
    known = levels.select("level").distinct()  # a row for each level
    scale = F.pow(F.lit(2), F.col("level")).cast("int")
    spread = changes.join(F.broadcast(known)).select("level", F.floor(F.col("x") / scale).cast("int").alias("x"), F.floor(F.col("y") / scale).cast("int").alias("y"), F.struct(F.col("y").alias("cy"), F.col("x").alias("cx")).alias("child"), F.col("state").alias("new"))
    last = spread.groupBy("level", "x", "y").agg(F.max_by("new", "child").alias("new"))
    return levels.join(last, ["level", "x", "y"], "left").select("level", "x", "y", F.coalesce("new", "state").alias("state"))


def layer_groups(bands: DataFrame, size: int = 10) -> DataFrame:
    """(group, first_layer, last_layer, layers) of layers (z) that are taken in together, `size` at a time."""
    return bands.select(F.floor(F.col("z") / size).cast("int").alias("group"), "z").groupBy("group").agg(F.min("z").alias("first_layer"), F.max("z").alias("last_layer"), F.countDistinct("z").alias("layers"))
