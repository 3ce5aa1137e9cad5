"""Fire fronts: perimeters as ordered rings, distances between fronts, and rates of spread.

A perimeter is all unit edges between a cell of a mask and one beside it, each directed with
the mask on its left.  An edge is followed by the edge that starts where it ends; where two
do, the one that turns left, so that cells that touch at a corner alone have rings of their
own.  Rings and the order along them come from pointer doubling: a join a round, as many
rounds as the length of the longest ring has bits, wherever its edges lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.operators import quadtree
from emberline.scratch import drop, stage

#: fixed by the definition: for each side of a cell the step to the cell beside it, and the corner where the edge starts and the one where it ends
SIDES = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]


def edges(mask: DataFrame) -> DataFrame:
    """(id, x, y, to_x, to_y, side) of the perimeter of cells (x, y); repeated cells count once."""
    cells = mask.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    sides = F.array(*[F.struct(F.lit(n).alias("side"), *[F.lit(v).cast("long").alias(k) for k, v in zip(("i", "j", "ax", "ay", "bx", "by"), s, strict=True)]) for n, s in enumerate(SIDES)])
    open_ = cells.select("x", "y", F.inline(sides)).withColumns({"nx": F.col("x") + F.col("i"), "ny": F.col("y") + F.col("j")})
    open_ = open_.join(cells.select(F.col("x").alias("nx"), F.col("y").alias("ny")), ["nx", "ny"], "left_anti")
    start = open_.select((F.col("x") + F.col("ax")).alias("x"), (F.col("y") + F.col("ay")).alias("y"), (F.col("x") + F.col("bx")).alias("to_x"), (F.col("y") + F.col("by")).alias("to_y"), "side")
    return start.select(F.struct("x", "y", "side").alias("id"), "x", "y", "to_x", "to_y", "side")


def rings(mask: DataFrame) -> DataFrame:
    """(ring, position, x, y): the corners of each ring of the perimeter in order, from 0 on.

    ring is the first edge of the ring in order of (x, y, side), where it starts.  The mask
    lies on the left, so outer rings run counter-clockwise (y upwards), holes clockwise.  An
    empty mask has none.
    """
    each = stage(edges(mask), "edges")
    after = each.select(F.col("id").alias("next"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("side").alias("turn"))
    # a left turn first: the next side counter-clockwise, then straight on, then right
    left = F.pmod(F.col("turn") - F.col("side"), F.lit(4))
    follows = each.join(after, ["to_x", "to_y"]).groupBy("id").agg(F.min_by("next", F.when(left == 1, 0).when(left == 0, 1).otherwise(2)).alias("next"))
    now = stage(follows.select("id", "next", F.least("id", "next").alias("least")), "rings")
    links = now.select(F.col("id"), F.col("next"))
    kept = now
    while True:
        there = now.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("least").alias("l"))
        new = stage(now.join(there, "next").select("id", F.col("beyond").alias("next"), F.least("least", "l").alias("least")), "rings")
        moved = new.join(now.select("id", F.col("least").alias("before")), "id").where("least <> before").count()
        if now is not kept:
            drop(now)
        now = new
        if not moved:  # then no ring is longer than what each edge has seen
            break
    ring = stage(now.select("id", F.col("least").alias("ring")), "ring-of")
    # the way back to the first edge: each edge knows the one before it, the first one stays
    back = links.select(F.col("next").alias("id"), F.col("id").alias("to")).join(ring, "id")
    first = F.col("id") == F.col("ring")
    walk = stage(back.select("id", "ring", F.when(first, F.col("id")).otherwise(F.col("to")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("position")), "walk")
    while not walk.where(F.col("to") != F.col("ring")).isEmpty():
        there = walk.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("position").alias("more"))
        new = stage(walk.join(there, "to").select("id", "ring", F.col("beyond").alias("to"), (F.col("position") + F.col("more")).alias("position")), "walk")
        drop(walk)
        walk = new
    return walk.select("ring", "position", F.col("id.x").alias("x"), F.col("id.y").alias("y"))


def ring_facts(found: DataFrame) -> DataFrame:
    """(ring, length, area): edges of each ring, and the cells that it encloses, negative for holes."""
    ahead = found.select("ring", F.col("position").alias("before"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    sizes = found.groupBy("ring").agg(F.count("*").alias("length"))
    turned = found.join(sizes, "ring").withColumn("before", F.pmod(F.col("position") + 1, F.col("length")))
    area = F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2
    return turned.join(ahead, ["ring", "before"]).groupBy("ring").agg(F.count("*").alias("length"), area.cast("long").alias("area"))


def front(mask: DataFrame) -> DataFrame:
    """(x, y) of the cells of a mask (x, y) with a side on its perimeter."""
    cells = mask.select("x", "y").distinct()
    near = F.array(*[F.struct(F.lit(s[0]).alias("i"), F.lit(s[1]).alias("j")) for s in SIDES])
    beside = cells.select("x", "y", F.inline(near)).withColumns({"nx": F.col("x") + F.col("i"), "ny": F.col("y") + F.col("j")})
    return beside.join(cells.select(F.col("x").alias("nx"), F.col("y").alias("ny")), ["nx", "ny"], "left_anti").select("x", "y").distinct()


def distances(start: DataFrame, end: DataFrame) -> DataFrame:
    """(x, y, d): how far each cell of a front (x, y) is from the nearest cell of another, exactly; null if that has none."""
    known = end.select(F.col("x").cast("double").alias("gx"), F.col("y").cast("double").alias("gy"), F.lit(0.0).alias("gz")).distinct()
    asked = stage(start.select("x", "y").withColumn("_row", F.monotonically_increasing_id()), "front")
    near = quadtree.nearest(asked.select("_row", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), stage(known, "front")).select("_row", F.col("near.d").alias("d"))
    return asked.join(near, "_row").select("x", "y", "d")


def spread_rate(before: DataFrame, after: DataFrame, steps: int, resolution: float = 5.0, minutes: float = 5.0) -> DataFrame:
    """(cells, mean_rate, max_rate): metres a minute from the front of a mask to that of a later one, over the cells of the later front that are new."""
    new = front(after).join(before.select("x", "y").distinct(), ["x", "y"], "left_anti")
    rate = F.col("d") * resolution / (steps * minutes)
    return distances(new, front(before)).agg(F.count("*").alias("cells"), F.avg(rate).alias("mean_rate"), F.max(rate).alias("max_rate"))


def front_error(simulated: DataFrame, observed: DataFrame, resolution: float = 5.0) -> DataFrame:
    """(mean_error, hausdorff) in metres: how far two fronts are apart, from each to the other."""
    a, b = front(simulated), front(observed)
    both = distances(a, b).unionByName(distances(b, a))
    return both.agg((F.avg("d") * resolution).alias("mean_error"), (F.max("d") * resolution).alias("hausdorff"))


def rate_error(simulated: tuple[DataFrame, DataFrame], observed: tuple[DataFrame, DataFrame], steps: int, resolution: float = 5.0, minutes: float = 5.0) -> DataFrame:
    """(simulated, observed, error, relative_error) of the mean rate of spread between two times, each as (before, after)."""
    one, two = (spread_rate(*pair, steps, resolution, minutes).select(F.col("mean_rate").alias(n)) for pair, n in ((simulated, "simulated"), (observed, "observed")))  # one row each
    out = one.join(F.broadcast(two)).withColumn("error", F.col("simulated") - F.col("observed"))
    return out.withColumn("relative_error", F.when(F.col("observed") > 0, F.col("error") / F.col("observed")))
