"""Tiles, regions and the planning of what to hold in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberline.schema import BURNED, BURNING
from emberline.scratch import drop, stage


def tile_grid(spark: SparkSession, width: int, height: int, tile: int, overlap: int = 0) -> DataFrame:
    """(tile_x, tile_y, x_min, x_max, y_min, y_max): tiles with bounds (end exclusive) that overlap."""
    stride = max(1, tile - overlap)
    across, down = -(-width // stride), -(-height // stride)
    ids = spark.range(across * down).select((F.col("id") % across).cast("int").alias("tile_x"), F.floor(F.col("id") / across).cast("int").alias("tile_y"))
    low = lambda c: F.col(c) * stride
    high = lambda c, n: F.least(F.lit(n), low(c) + tile)
    return ids.select("tile_x", "tile_y", low("tile_x").alias("x_min"), high("tile_x", width).alias("x_max"), low("tile_y").alias("y_min"), high("tile_y", height).alias("y_max"))


def tile_of(cells: DataFrame, stride: int) -> DataFrame:
    return cells.withColumns({f"tile_{c}": F.floor(F.col(c) / stride).cast("int") for c in "xy"})


def cells_of(cells: DataFrame, tiles: DataFrame, stride: int, tile: int) -> DataFrame:
    """cells with every tile that holds them; overlapping tiles give more than one row.

    A tile is at most ceil(tile / stride) strides wide, so a cell names its tiles itself.
    """
    back = -(-tile // stride)
    spread = tile_of(cells, stride)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(back) for j in range(back)])
    named = spread.withColumn("o", F.explode(steps)).select(*cells.columns, (F.col("tile_x") - F.col("o.i")).alias("tile_x"), (F.col("tile_y") - F.col("o.j")).alias("tile_y"))
    met = named.join(tiles, ["tile_x", "tile_y"])
    return met.where((F.col("x") >= F.col("x_min")) & (F.col("x") < F.col("x_max")) & (F.col("y") >= F.col("y_min")) & (F.col("y") < F.col("y_max")))


def tile_neighbours(tiles: DataFrame, diagonal: bool = True) -> DataFrame:
    """(tile_x, tile_y, near_x, near_y) of neighbouring tiles of the grid."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    asked = tiles.select("tile_x", "tile_y", F.inline(around)).select("tile_x", "tile_y", (F.col("tile_x") + F.col("i")).alias("near_x"), (F.col("tile_y") + F.col("j")).alias("near_y"))
    return asked.join(tiles.select(F.col("tile_x").alias("near_x"), F.col("tile_y").alias("near_y")), ["near_x", "near_y"]).select("tile_x", "tile_y", "near_x", "near_y")


def region_tiles(regions: DataFrame, stride: int, across: int, down: int) -> DataFrame:
    """(region_id, tile_x, tile_y) of the tiles of the grid that regions (region_id, x, y, w, h) cover, ends included.

    What lies off the grid is clipped; a region beside it has no tiles.
    """

    def span(c: str, w: str, n: int):
        low, high = F.greatest(F.lit(0), F.floor(F.col(c) / stride)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(c) + F.col(w)) / stride)).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    return regions.withColumn("tile_x", span("x", "w", across)).withColumn("tile_y", span("y", "h", down)).select("region_id", "tile_x", "tile_y")


def tile_activity(cells: DataFrame, stride: int) -> DataFrame:
    """(tile_x, tile_y, burning, touched, can_rest) of tiles that hold cells (x, y, state).

    A tile can rest if neither it nor one of its four neighbours burns.
    """
    per = tile_of(cells, stride).groupBy("tile_x", "tile_y").agg(F.count_if(F.col("state") == BURNING).alias("burning"), F.bool_or(F.col("state").isin(BURNING, BURNED)).alias("touched"))
    lit = tile_neighbours(per.select("tile_x", "tile_y"), diagonal=False).join(per.where("burning > 0").select(F.col("tile_x").alias("near_x"), F.col("tile_y").alias("near_y")), ["near_x", "near_y"], "left_semi")
    near = lit.select("tile_x", "tile_y").distinct().withColumn("near", F.lit(True))
    return per.join(near, ["tile_x", "tile_y"], "left").select("tile_x", "tile_y", "burning", "touched", ((F.col("burning") == 0) & F.col("near").isNull()).alias("can_rest"))


def to_activate(active: DataFrame, cells: DataFrame, stride: int) -> DataFrame:
    """(tile_x, tile_y) next to burning tiles that are not active yet."""
    acts = tile_activity(cells, stride)
    near = tile_neighbours(acts.select("tile_x", "tile_y")).join(acts.where("burning > 0").select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_semi")
    return near.select(F.col("near_x").alias("tile_x"), F.col("near_y").alias("tile_y")).distinct().join(active, ["tile_x", "tile_y"], "left_anti")


def valid_tiles(asked: DataFrame, across: int, down: int) -> DataFrame:
    """asked (tile_x, tile_y) with valid: whether the grid has such a tile; nulls are not valid."""
    inside = F.col("tile_x").between(0, across - 1) & F.col("tile_y").between(0, down - 1)
    return asked.withColumn("valid", F.coalesce(inside, F.lit(False)))


def eviction(tiles: DataFrame, budget: float) -> DataFrame:
    """tiles (tile_x, tile_y, size, last_used) with the running size from the latest use, and whether they stay."""
    recent = Window.orderBy(F.col("last_used").desc(), "tile_x", "tile_y").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as loaded tiles
    return tiles.withColumn("running", F.sum("size").over(recent)).withColumn("stays", F.col("running") <= budget)


def _levelled(boxes: DataFrame, corners: tuple[str, str, str, str] = ("x_min", "x_max", "y_min", "y_max")) -> DataFrame:
    """boxes with the squares (level, sx, sy), four at most, of the grid of their own size: squares of level k are 2^k wide."""
    a, b, c, e = corners
    wide = F.greatest(F.col(b) - F.col(a), F.col(e) - F.col(c), F.lit(1))
    out = boxes.withColumn("level", F.ceil(F.log2(wide.cast("double"))).cast("int"))
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.pow(F.lit(2.0), "level")).cast("long"), F.floor(F.col(high) / F.pow(F.lit(2.0), "level")).cast("long")))
    return out.withColumn("sx", span(a, b)).withColumn("sy", span(c, e))


def _met(boxes: DataFrame) -> DataFrame:
    """(id, oid) of boxes that touch, both ways, themselves included.

    A box lies in squares of its own size.  It meets the boxes of its own level there, and
    larger ones in the squares above; those that both lie in are found by each once.
    """
    corners = ("x_min", "x_max", "y_min", "y_max")
    listed = stage(_levelled(boxes).select("id", *corners, "level", "sx", "sy"), "levelled")
    there = [r[0] for r in listed.select("level").distinct().collect()]  # 64 at most
    above = F.filter(F.array(*[F.lit(v) for v in sorted(there)]).cast("array<int>"), lambda v: v >= F.col("level"))
    up = listed.withColumn("up", F.explode(above)).withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("up") - F.col("level"))).cast("long") for c in ("sx", "sy")})
    up = up.select("id", *corners, F.col("up").alias("level"), "sx", "sy").distinct()
    large = listed.select(F.col("id").alias("oid"), *[F.col(c).alias(f"o_{c}") for c in corners], "level", "sx", "sy")
    touch = (F.col("x_min") <= F.col("o_x_max")) & (F.col("x_max") >= F.col("o_x_min")) & (F.col("y_min") <= F.col("o_y_max")) & (F.col("y_max") >= F.col("o_y_min"))
    pairs = up.join(large, ["level", "sx", "sy"]).where(touch).select("id", "oid")
    return pairs.unionByName(pairs.select(F.col("oid").alias("id"), F.col("id").alias("oid")))


def merge_regions(regions: DataFrame) -> DataFrame:
    """(x_min, x_max, y_min, y_max): boxes that touch are merged into their hull, to a fixpoint.

    A hull may touch new boxes, so groups of touching boxes are merged again until none
    touch; a round without a merge leaves all boxes, and any other leaves fewer.  Each box
    is listed under the squares of its own size and of the larger sizes there are, a few
    for each, so one wide box among many small ones costs what a small one does.
    """
    corners = ("x_min", "x_max", "y_min", "y_max")
    boxes = stage(regions.select(F.xxhash64(*corners).alias("id"), *corners).distinct(), "boxes")
    count = boxes.count()
    while count:
        least = _met(boxes).groupBy("id").agg(F.min("oid").alias("to"))
        merged = boxes.join(least, "id").groupBy("to").agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
        new = stage(merged.select(F.xxhash64(*corners).alias("id"), *corners).distinct(), "boxes")
        drop(boxes)
        boxes, before, count = new, count, new.count()
        if count == before:
            break
    return boxes.drop("id")


def regions_around(cells: DataFrame, width: int, height: int, reach: int = 20, margin: int = 0) -> DataFrame:
    """A box of `reach` cells around each burning cell, clipped to the grid."""
    lit = cells.where(F.col("state") == BURNING)
    low = lambda c: F.greatest(F.lit(0), F.col(c) - reach - margin)
    high = lambda c, n: F.least(F.lit(n - 1), F.col(c) + reach + margin)
    return lit.select(low("x").alias("x_min"), high("x", width).alias("x_max"), low("y").alias("y_min"), high("y", height).alias("y_max")).distinct()


def in_regions(cells: DataFrame, regions: DataFrame, side: int = 64) -> DataFrame:
    """cells that lie in a box; boxes are listed under the squares they touch, so this is an equality join."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor(F.col(b) / side).cast("int")))
    listed = regions.withColumn("tile_x", span("x_min", "x_max")).withColumn("tile_y", span("y_min", "y_max"))
    named = tile_of(cells, side)
    inside = (named.tile_x == listed.tile_x) & (named.tile_y == listed.tile_y) & named.x.between(listed.x_min, listed.x_max) & named.y.between(listed.y_min, listed.y_max)
    return named.join(listed, inside, "left_semi").select(cells.columns)


def multi_resolution(levels: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """(x, y, level, state): the finest level that a region asks for where a cell lies, the coarsest there is elsewhere.

    levels: (level, x, y, state) of a pyramid, where level k has a cell for 2^k by 2^k of
    the finest.  regions: boxes (x_min, x_max, y_min, y_max) of finest cells, ends included,
    with the level that each asks for (0 without such a column).  A pyramid may be sparse: a
    cell takes the value of the finest known ancestor from its level on.  Known cells are
    looked up by their code, the bits of x and y in turn, of which an ancestor's is a
    prefix; a cell that no level knows is left out.
    """
    there = sorted(r[0] for r in levels.select("level").distinct().collect())  # a row for each level
    if not there:
        return cells.sparkSession.createDataFrame([], "x int, y int, level int, state int")
    asked_for = regions if "level" in regions.columns else regions.withColumn("level", F.lit(0))
    at = lambda c: F.col(c).cast("long")
    inside = _inside(cells.select("x", "y"), asked_for).groupBy("x", "y").agg(F.min("level").alias("_from"))
    wanted = cells.select("x", "y").join(inside, ["x", "y"], "left").withColumn("_from", F.coalesce("_from", F.lit(there[-1])))
    open_levels = F.filter(F.array(*[F.lit(v) for v in there]).cast("array<int>"), lambda v: v >= F.col("_from"))
    spread = wanted.withColumn("level", F.explode(open_levels))
    prefix = F.call_function("shiftright", morton(at("x"), at("y")), F.col("level") * 2)
    known = levels.select("level", morton(at("x"), at("y")).alias("code"), "state")
    met = spread.withColumn("code", prefix).join(known, ["level", "code"])
    return met.groupBy("x", "y").agg(F.min(F.struct("level", "state")).alias("m")).select("x", "y", "m.level", "m.state")


def morton(x: Column, y: Column) -> Column:
    """The bits of two numbers below 2^31 (as longs) in turn, x above y."""

    def spread(v: Column) -> Column:
        for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(x), 1).bitwiseOR(spread(y))


def _inside(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(x, y, level) of cells and the boxes that hold them; a box is listed under squares of its own size, a cell under those of each size there is."""
    corners = ("x_min", "x_max", "y_min", "y_max")
    boxes = stage(_levelled(regions.select(*corners, F.col("level").alias("asked"))), "regions")
    sizes = [r[0] for r in boxes.select("level").distinct().collect()]  # 64 at most
    spread = cells.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sizes]).cast("array<int>")))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level")).cast("long")
    met = spread.withColumns({"sx": at("x"), "sy": at("y")}).join(boxes, ["level", "sx", "sy"])
    return met.where("x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max").select("x", "y", F.col("asked").alias("level"))
