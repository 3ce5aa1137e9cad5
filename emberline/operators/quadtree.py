"""Equi-depth quadtree of a point table, and the nearest-neighbour join over it.

The square around all points is cut into quarters until a cell holds few of them, however
uneven they lie.  Counts come from partial aggregation; only cells that are still crowded
at the depth that even data would need are counted deeper.  Leaves cover the whole square,
those without points included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.scratch import drop, stage

#: the finest level
DEEPEST = 24
#: levels that a crowded cell is counted deeper at once
FURTHER = 4
#: ground points of a leaf of the nearest-neighbour join, at most, and of a window, in leaves
NEAREST_ROWS = 32
WINDOW_LEAVES = 16
KEY = ["level", "ix", "iy"]


@dataclass(frozen=True)
class Frame:
    """The square that level 0 is."""

    x0: float
    y0: float
    side: float

    def deep(self, c: Column, low: float) -> Column:
        """The index at the finest level; what lies outside the square counts as its border."""
        n = 1 << DEEPEST
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c - F.lit(low)) * F.lit(n / self.side)))).cast("long")

    def width(self, level: Column) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), level)

    def box(self, level: int, ix: int, iy: int) -> tuple[float, float, float, float]:
        """(x from, x to, y from, y to) of a cell."""
        w = self.side / (1 << level)
        return self.x0 + ix * w, self.x0 + (ix + 1) * w, self.y0 + iy * w, self.y0 + (iy + 1) * w


def frame_of(points: DataFrame) -> tuple[Frame, int]:
    """The square of all points (x, y), and their number."""
    n, a, b, c, d = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return (Frame(a, c, max(b - a, d - c) * (1 + 1e-9) or 1.0), n) if n else (Frame(0.0, 0.0, 1.0), 0)


def deepened(points: DataFrame, frame: Frame) -> DataFrame:
    return points.withColumns({"_dx": frame.deep(F.col("x"), frame.x0), "_dy": frame.deep(F.col("y"), frame.y0)})


def _at(level: Column, c: str) -> Column:
    return F.call_function("shiftright", F.col(c), F.lit(DEEPEST) - level)


def nodes(points: DataFrame, frame: Frame, n: int, rows: int) -> DataFrame:
    """(level, ix, iy, n, leaf): the cells of the tree, level by level, staged.

    A cell of more than `rows` points is split, unless it is of the finest level.
    """
    left = deepened(points, frame).select("_dx", "_dy")
    low, high = 0, max(1, min(12, math.ceil(math.log(max(n / rows, 1), 4)) + 2))
    counted = []
    while True:
        at = F.lit(high)
        cells = stage(left.groupBy(_at(at, "_dx").alias("ix"), _at(at, "_dy").alias("iy")).agg(F.count("*").alias("n")), "cells")
        up = cells.withColumn("level", F.explode(F.sequence(F.lit(low), at)))
        shifted = [F.call_function("shiftright", F.col(c), at - F.col("level")).alias(c) for c in ("ix", "iy")]
        counted.append(up.select("level", *shifted, "n").groupBy(*KEY).agg(F.sum("n").alias("n")))
        hot = cells.where(F.col("n") > rows).select(F.col("ix").alias("hx"), F.col("iy").alias("hy"))
        if high == DEEPEST or hot.isEmpty():
            break
        left = left.join(hot, (_at(at, "_dx") == F.col("hx")) & (_at(at, "_dy") == F.col("hy")), "left_semi")
        low, high = high + 1, min(DEEPEST, high + FURTHER)
    counts = stage(reduce(DataFrame.unionByName, counted), "counts")
    split = counts.where((F.col("n") > rows) & (F.col("level") < DEEPEST)).select(*KEY)
    quarter = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    below = split.select((F.col("level") + 1).alias("level"), F.col("ix"), F.col("iy"), F.inline(quarter))
    below = below.select("level", (F.col("ix") * 2 + F.col("i")).alias("ix"), (F.col("iy") * 2 + F.col("j")).alias("iy"))
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"))
    known = root.unionByName(below).join(counts, KEY, "left").na.fill(0, ["n"])
    return stage(known.withColumn("leaf", (F.col("n") <= rows) | (F.col("level") == DEEPEST)), "nodes")


def levels_of(leaves: DataFrame) -> list[int]:
    return sorted(r[0] for r in leaves.select("level").distinct().collect())  # at most DEEPEST + 1


def located(points: DataFrame, leaves: DataFrame, frame: Frame) -> DataFrame:
    """points with the leaf (level, ix, iy) that they lie in."""
    levels = F.array(*[F.lit(v) for v in levels_of(leaves)])
    asked = deepened(points, frame).withColumn("level", F.explode(levels))
    asked = asked.withColumns({"ix": _at(F.col("level"), "_dx"), "iy": _at(F.col("level"), "_dy")}).drop("_dx", "_dy")
    return asked.join(leaves.select(*KEY), KEY)


def in_windows(points: DataFrame, leaves: DataFrame, frame: Frame, rim: float = 0.5) -> DataFrame:
    """points with each leaf (level, ix, iy) whose box, wider by rim (to 0.5) of its width, holds them, and whether it is their own."""
    levels = F.array(*[F.lit(v) for v in levels_of(leaves)])
    asked = deepened(points, frame).withColumn("level", F.explode(levels))
    asked = asked.withColumns({"_w": frame.width(F.col("level")), "_ox": _at(F.col("level"), "_dx"), "_oy": _at(F.col("level"), "_dy")}).drop("_dx", "_dy")
    part = lambda c, low, o: (F.col(c) - F.lit(low)) / F.col("_w") - F.col(o)
    step = lambda p: F.when(p < rim, -1).when(p > 1 - rim, 1).otherwise(0)
    asked = asked.withColumns({"_sx": step(part("x", frame.x0, "_ox")), "_sy": step(part("y", frame.y0, "_oy"))})
    moves = F.array_distinct(F.array(*[F.struct((F.col("_sx") * i).alias("i"), (F.col("_sy") * j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    spread = asked.select("*", F.inline(moves)).withColumns({"ix": F.col("_ox") + F.col("i"), "iy": F.col("_oy") + F.col("j"), "own": (F.col("i") == 0) & (F.col("j") == 0)})
    return spread.drop("_w", "_ox", "_oy", "_sx", "_sy", "i", "j").join(leaves.select(*KEY), KEY)


def _edges(frame: Frame) -> tuple[Column, Column, Column, Column]:
    w = frame.width(F.col("level"))
    return F.lit(frame.x0) + F.col("ix") * w, F.lit(frame.x0) + (F.col("ix") + 1) * w, F.lit(frame.y0) + F.col("iy") * w, F.lit(frame.y0) + (F.col("iy") + 1) * w


def _apart(frame: Frame) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance of (x, y) from the cell."""
    x, y = F.col("x"), F.col("y")
    a, b, c, d = _edges(frame)
    out = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    far = lambda v, low, high: F.greatest(F.abs(v - low), F.abs(v - high))
    return out(x, a, b) ** 2 + out(y, c, d) ** 2, far(x, a, b) ** 2 + far(y, c, d) ** 2


def _near_of(points: str) -> Column:
    d = lambda g: F.sqrt((F.col("x") - g["gx"]) ** 2 + (F.col("y") - g["gy"]) ** 2)
    return F.array_min(F.transform(points, lambda g: F.struct(d(g).alias("d"), g["gz"].alias("gz"))))


def _descended(asked: DataFrame, tree: DataFrame, held: DataFrame, frame: Frame) -> DataFrame:
    """(_row, near) of asked (_row, x, y) by going down the tree: cells beyond the farthest point that a nearer cell must have are left."""
    full = tree.where("n > 0")
    key = [F.col(c) for c in KEY]
    children = full.select(*[c.alias(f"c_{n}") for c, n in zip(key, KEY, strict=True)], F.col("leaf").alias("c_leaf"), (F.col("level") - 1).alias("level"), F.call_function("shiftright", "ix", F.lit(1)).alias("ix"), F.call_function("shiftright", "iy", F.lit(1)).alias("iy"))
    zero = F.lit(0).cast("long")
    now = stage(asked.select("_row", "x", "y").join(F.broadcast(full.where("level = 0").select("leaf")).withColumns({"level": F.lit(0), "ix": zero, "iy": zero})), "descent")  # one row
    while not now.where("NOT leaf").isEmpty():
        opened = now.where("NOT leaf").join(children, KEY).select("_row", "x", "y", *[F.col(f"c_{n}").alias(n) for n in KEY], F.col("c_leaf").alias("leaf"))
        least, most = _apart(frame)
        both = opened.unionByName(now.where("leaf").select(opened.columns)).withColumns({"_least": least, "_most": most})
        bound = F.min("_most").over(Window.partitionBy("_row"))
        new = stage(both.withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound") * (1 + 1e-9)).select(opened.columns), "descent")
        drop(now)
        now = new
    return now.join(held, KEY).withColumn("near", _near_of("of")).groupBy("_row").agg(F.min("near").alias("near"))


def nearest(points: DataFrame, ground: DataFrame, rows: int = NEAREST_ROWS) -> DataFrame:
    """points (_row, x, y, ...) with near (d, gz): the distance of the nearest ground point (gx, gy, gz) and its height, of equally near ones the lowest.

    Every leaf has the list of the ground points within half its width around it.  A point
    looks its own leaf up, and a nearest one within that rim is certain.  Points without
    one, and those of leaves whose rim reaches into much denser ground, go down the tree.
    So a point meets a bounded number of ground points wherever they lie.  x and y have to
    be numbers; without ground near is null.
    """
    named = ground.select(F.col("gx").alias("x"), F.col("gy").alias("y"), "gz")
    frame, n = frame_of(named)
    if not n:
        return points.withColumn("near", F.lit(None).cast("struct<d:double,gz:double>"))
    tree = nodes(named, frame, n, rows)
    leaves = tree.where("leaf")
    placed = stage(in_windows(named, leaves, frame), "windows")
    one = F.struct(F.col("x").alias("gx"), F.col("y").alias("gy"), "gz")
    crowded = placed.groupBy(*KEY).agg(F.count("*").alias("m")).where(F.col("m") > WINDOW_LEAVES * rows).select(*KEY)
    around = placed.join(crowded, KEY, "left_anti").groupBy(*KEY).agg(F.collect_list(one).alias("of"))
    asked = stage(located(points.select("_row", "x", "y"), leaves, frame).join(around, KEY, "left").withColumn("near", _near_of("of")).drop("of"), "asked")
    a, b, c, d = _edges(frame)
    half = frame.width(F.col("level")) / 2
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) - 1
    side = lambda at_border, rest: F.when(at_border, F.lit(float("inf"))).otherwise(rest)
    border = F.least(
        side(F.col("ix") == 0, F.col("x") - (a - half)), side(F.col("ix") == last, b + half - F.col("x")),
        side(F.col("iy") == 0, F.col("y") - (c - half)), side(F.col("iy") == last, d + half - F.col("y")),
    )
    sure = F.coalesce(F.col("near.d") <= border * (1 - 1e-9), F.lit(False))
    certain, rest = asked.where(sure).select("_row", "near"), asked.where(~sure).select("_row", "x", "y")
    if not rest.isEmpty():
        held = located(named, leaves, frame).groupBy(*KEY).agg(F.collect_list(one).alias("of"))
        certain = certain.unionByName(_descended(rest, tree, held, frame))
    return points.join(certain, "_row", "left")
