"""One step of fire spread: horizontal, vertical and by embers.

The tables: `static` (x, y, z, conn_up, moisture, u, v, dir, speed) never changes, `state`
(x, y, z, state, fuel) does.  Only burning voxels act, so every join starts from them and
the rest of the grid is touched once, by the update.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from emberline.config import Config
from emberline.functions import fire
from emberline.functions.rng import normal, uniform
from emberline.schema import BURNED, BURNING, UNBURNED

KEY = ["x", "y", "z"]


def _inside(width: int, height: int, open_edge: bool):
    """Edge voxels do not act unless the edge is open."""
    return F.lit(True) if open_edge else F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)


def _spread(cells: DataFrame) -> DataFrame:
    """A row for each of the eight neighbours in the layer."""
    moves = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in fire.NEIGHBOURS])
    return cells.select("*", F.inline(moves)).withColumns({"tx": F.col("x") + F.col("dx"), "ty": F.col("y") + F.col("dy")})


def burning_neighbours(state: DataFrame) -> DataFrame:
    """(x, y, z, n) of voxels with burning neighbours in their layer."""
    lit = state.where(F.col("state") == BURNING).select(KEY)
    return _spread(lit).groupBy(F.col("tx").alias("x"), F.col("ty").alias("y"), "z").agg(F.count("*").alias("n"))


def horizontal(state: DataFrame, static: DataFrame, step: int, c: Config, width: int, height: int, open_edge: bool = False) -> DataFrame:
    """The state after burning and spreading within layers, all from one snapshot."""
    burning = state.where((F.col("state") == BURNING) & _inside(width, height, open_edge))
    burnt = burning.withColumn("left", F.col("fuel") - fire.consumption_rate(F.col("z"), c.num_layers, c.fuel_consumption_rate))
    after = burnt.select(*KEY, F.when(F.col("left") <= 0, BURNED).otherwise(BURNING).alias("new_state"), F.greatest(F.lit(0.0), "left").alias("new_fuel"))
    sources = burnt.where("left > 0").select(KEY).join(static.select(*KEY, "u", "v"), KEY)
    tries = _spread(sources).select(F.col("tx").alias("x"), F.col("ty").alias("y"), "z", "dx", "dy", "u", "v", F.col("x").alias("sx"), F.col("y").alias("sy"))
    targets = state.where((F.col("state") == UNBURNED) & (F.col("fuel") > 0)).select(*KEY, "fuel")
    tries = tries.join(targets, KEY).join(static.select(*KEY, "moisture"), KEY).join(burning_neighbours(state), KEY)
    wind = fire.wind_effect(F.col("u"), F.col("v"), F.col("dx"), F.col("dy"), c.wind_effect_max)
    diagonal = F.abs("dx") + F.abs("dy") > 1
    p = fire.horizontal_probability(F.col("n"), F.col("fuel"), wind, F.col("moisture"), diagonal, c.diagonal_factor, c.sigmoid_steepness, c.sigmoid_threshold)
    draw = uniform(c.random_seed, step, "h", F.col("sx"), F.col("sy"), F.col("z"), F.col("x"), F.col("y"), F.col("z"))
    lit = tries.withColumn("p", p).where((F.col("p") > c.spread_threshold) & (draw < F.col("p"))).select(KEY).distinct()
    changes = after.unionByName(lit.select(*KEY, F.lit(BURNING).alias("new_state"), F.lit(None).cast("double").alias("new_fuel")))
    return _apply(state, changes)


def _apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    joined = state.join(changes, KEY, "left")
    return joined.select(*KEY, F.coalesce("new_state", "state").cast("int").alias("state"), F.coalesce("new_fuel", "fuel").alias("fuel"))


def vertical_lit(state: DataFrame, static: DataFrame, step: int, c: Config, width: int, height: int, open_edge: bool = False) -> DataFrame:
    """(x, y, z) that burning voxels light above and below them."""
    burning = state.where((F.col("state") == BURNING) & _inside(width, height, open_edge)).select(KEY)
    sources = burning.join(static.select(*KEY, "conn_up"), KEY)
    moves = F.array(F.struct(F.lit(1).alias("dz")), F.struct(F.lit(-1).alias("dz")))
    tries = sources.select("x", "y", F.col("z").alias("sz"), "conn_up", F.inline(moves)).withColumn("z", F.col("sz") + F.col("dz"))
    targets = state.where((F.col("state") == UNBURNED) & (F.col("fuel") > 0)).select(*KEY, "fuel").join(static.select(*KEY, "moisture"), KEY)
    tries = tries.join(targets, KEY)
    up = fire.upward_probability(F.col("conn_up"), F.col("moisture"), F.col("fuel"), F.col("sz"), c.canopy_start_layer, c.crown_multiplier)
    p = F.when(F.col("dz") == 1, up).otherwise(fire.downward_probability(F.col("fuel"), c.downward_spread))
    draw = uniform(c.random_seed, step, "v", F.col("x"), F.col("y"), F.col("sz"), F.col("x"), F.col("y"), F.col("z"))
    return tries.where(draw < p).select(KEY)


def embers(state: DataFrame, static: DataFrame, step: int, c: Config, width: int, height: int, open_edge: bool = False, y_sign: int = 1) -> DataFrame:
    """One row for each ember that lands on unburned fuel: source, target, flight and whether it ignites."""
    burning = state.where((F.col("state") == BURNING) & _inside(width, height, open_edge)).select(KEY)
    own = (F.col("x"), F.col("y"), F.col("z"))
    throwing = burning.where(uniform(c.random_seed, step, "e", *own) < c.ember_probability).join(static.select(*KEY, "dir", F.col("speed").alias("wind")), KEY)
    count = F.lit(1) + F.floor(uniform(c.random_seed, step, "en", *own) * c.embers_per_cell).cast("int")
    thrown = throwing.withColumn("k", F.explode(F.sequence(F.lit(1), count)))
    draw = fire.ember_draw(F.col("dir"), F.col("wind"), *own, c.ember_distance, c.ember_rise, y_sign, c.random_seed, step, "ed", *own, F.col("k"))
    flown = thrown.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "k", draw.alias("e")).select("sx", "sy", "sz", "k", "e.*")
    landed = flown.where(F.col("tx").between(0, width - 1) & F.col("ty").between(0, height - 1))
    targets = state.where((F.col("state") == UNBURNED) & (F.col("fuel") > 0)).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), "fuel")
    hit = landed.join(targets, ["tx", "ty", "tz"])
    p = fire.ember_probability(F.col("distance"), F.col("vertical"), F.col("fuel"), c.ember_distance, c.ember_ignition, c.ember_min_probability, c.ember_vertical_penalty, c.ember_fuel_multiplier)
    luck = uniform(c.random_seed, step, "ei", F.col("sx"), F.col("sy"), F.col("sz"), F.col("k"))
    out = hit.withColumn("p", p).withColumn("ignited", luck < F.col("p"))
    return out.withColumn("travel_time", F.greatest(F.lit(1), F.floor(F.col("distance") / 2).cast("int")))


def spotting(state: DataFrame, static: DataFrame, step: int, c: Config, width: int, height: int, probability: float = 0.01, farthest: float = 100.0, wind_influence: float = 0.8) -> DataFrame:
    """One row for each far-flying ember that lands on an unburned voxel: source, target, metres, chance and whether it ignites.

    The other ember model: burning voxels with fuel over 0.3 throw one at most, the likelier the
    higher and fuller they are; distances in metres are lognormal, directions scatter around the
    wind as compass bearings, and moisture at the target hinders ignition.
    """
    own = (F.col("x"), F.col("y"), F.col("z"))
    chance = F.lit(probability) * (F.lit(0.5) + F.lit(0.5) * F.col("z") / F.lit(float(max(1, c.num_layers - 1)))) * F.least(F.lit(1.0), F.col("fuel") / F.lit(0.5))
    throwing = state.where((F.col("state") == BURNING) & (F.col("fuel") > 0.3)).where(uniform(c.random_seed, step, "so", *own) < chance).select(KEY).join(static.select(*KEY, "dir", "speed"), KEY)
    metres = F.least(F.lit(farthest), F.exp(F.lit(math.log(farthest / 3)) + F.lit(0.7) * normal(c.random_seed, step, "sd", *own))) * (F.lit(1.0) + F.lit(wind_influence) * F.col("speed") / F.lit(10.0))
    bearing = F.col("dir") + F.lit(math.pi / 8) * normal(c.random_seed, step, "sa", *own)
    flown = throwing.select(*[F.col(k).alias(f"s{k}") for k in KEY], metres.alias("metres"), bearing.alias("bearing"), (F.floor(uniform(c.random_seed, step, "sz", *own) * 2)).cast("int").alias("fall"))
    cells = F.col("metres") / F.lit(c.model_resolution)
    landed = flown.select("*", (F.col("sx") + F.sin("bearing") * cells).cast("int").alias("x"), (F.col("sy") + F.cos("bearing") * cells).cast("int").alias("y"), F.greatest(F.lit(0), F.col("sz") - F.col("fall")).alias("z"))
    landed = landed.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    hit = landed.join(state.where(F.col("state") == UNBURNED).select(*KEY, "fuel"), KEY).join(static.select(*KEY, "moisture"), KEY)
    p = F.lit(0.4) * (F.lit(1.0) - F.lit(0.8) * F.col("moisture")) * F.least(F.lit(1.0), F.col("fuel") / F.lit(0.3))
    luck = uniform(c.random_seed, step, "si", F.col("sx"), F.col("sy"), F.col("sz"))
    return hit.withColumn("p", p).select("sx", "sy", "sz", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), "metres", "p", (luck < F.col("p")).alias("ignited"))


def ember_records(landed: DataFrame, step: int) -> DataFrame:
    """The records of a step's embers as nested rows."""
    time = F.col("travel_time")
    source = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    target = F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    velocity = F.struct(((F.col("tx") - F.col("sx")) / time).alias("vx"), ((F.col("ty") - F.col("sy")) / time).alias("vy"), (F.col("vertical") / time).alias("vz"))
    return landed.select(F.lit(step).alias("step"), source.alias("source"), target.alias("target"), "angle", "distance", F.col("vertical").alias("vertical_travel"), F.col("p").alias("ignition_prob"), "ignited", velocity.alias("velocity"), "travel_time", time.alias("remaining_steps"))


def vertical(state: DataFrame, static: DataFrame, step: int, c: Config, width: int, height: int, open_edge: bool = False, y_sign: int = 1) -> DataFrame:
    """The state after vertical spread and embers, both from the state after the horizontal step."""
    up_down = vertical_lit(state, static, step, c, width, height, open_edge)
    flown = embers(state, static, step, c, width, height, open_edge, y_sign).where("ignited").select(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    lit = up_down.unionByName(flown).distinct()
    return _apply(state, lit.select(*KEY, F.lit(BURNING).alias("new_state"), F.lit(None).cast("double").alias("new_fuel")))


def simple_step(cells: DataFrame, step: int, width: int, height: int, seed: int = 42) -> DataFrame:
    """(x, y, state, vegetation) after a step of the plain automaton with four neighbours.

    An unburned cell with vegetation over 0.2 gets a chance from each burning neighbour;
    after a success its vegetation shrinks.  A burning cell burns out with chance 0.1.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in fire.NEIGHBOURS[:4]])
    near = cells.where(F.col("state") == BURNING).select("x", "y", F.inline(sides)).groupBy((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(F.count("*").alias("n"))
    joined = cells.join(near, ["x", "y"], "left")
    inner = F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)
    open_ = inner & (F.col("state") == UNBURNED) & (F.col("vegetation") > 0.2)
    chances = F.transform(F.sequence(F.lit(1), F.coalesce("n", F.lit(0)) + 1), lambda i: uniform(seed, step, "s", F.col("x"), F.col("y"), i))
    drawn = F.aggregate(F.slice(chances, 1, F.coalesce("n", F.lit(0)).cast("int")), F.struct(F.col("vegetation").alias("v"), F.lit(False).alias("lit")), lambda s, u: F.when(u < s["v"], F.struct((s["v"] * 0.8).alias("v"), F.lit(True).alias("lit"))).otherwise(s))
    out = inner & (F.col("state") == BURNING) & (uniform(seed, step, "o", F.col("x"), F.col("y")) < 0.1)
    new = joined.withColumn("d", F.when(open_, drawn)).withColumn("out", out)
    state = F.when(F.col("out"), BURNED).when(F.coalesce(F.col("d.lit"), F.lit(False)), BURNING).otherwise(F.col("state"))
    return new.select("x", "y", state.cast("int").alias("state"), F.when(F.col("out"), 0.0).otherwise(F.coalesce("d.v", "vegetation")).alias("vegetation"))
