"""The simulation loop, its statistics, history and ensembles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from emberline.config import Config
from emberline.functions import fire
from emberline.operators import blocks, spread
from emberline.schema import BURNED, BURNING, UNBURNED
from emberline.scratch import drop, stage


#: steps that blocks work out before their rims move
ROUND = 8


def run(state: DataFrame, static: DataFrame, c: Config, width: int, height: int, steps: int, open_edge: bool = False, listen: Callable[[int, DataFrame], None] | None = None, history: list | None = None, first: int = 0, y_sign: int = 1) -> DataFrame:
    """The state after `steps` steps, or after the fire is out.

    Blocks of the grid go on for a round of steps by themselves (see blocks); only those
    near fire take part, and each round is written to the shared scratch, which cuts the
    plan.  The driver sees one number for a step.  history, if given, receives (step, table)
    of all steps, which then stay; listen is called with the same.  first: the number of the
    first step, for a run that goes on from a stored state.
    """
    spread_from = state.agg(F.max("z")).first()[0]
    rules = blocks.rules(c, width, height, 0 if spread_from is None else int(spread_from) + 1, open_edge, y_sign)
    side = blocks.block_side(rules.layers)
    now = stage(blocks.to_blocks(state, static, rules, side).withColumn("step", F.lit(first)), "blocks")
    told = history is not None or listen is not None
    at, last, alone = first, first + steps, width <= side and height <= side
    if told and steps:
        _tell(first, now, listen, history)
    while at < last:
        if not (now.where(F.col("burning") > 0).count() if c.stop_when_fire_extinguished else 1):
            return blocks.voxels(now)
        count = min(last - at, last if alone else max(1, min(ROUND, side // rules.reach)))
        done = blocks.round_of(now, rules, side, at, count, told)
        if told:
            lit = dict(done.groupBy("step").agg(F.sum("burning")).collect())  # a row for each step of the round
            for step in range(at + 1, at + count + 1):
                frame = done.where(F.col("step") == step)
                if step < last or history is not None:
                    _tell(step, frame, listen if step < last else None, history)
                if c.stop_when_fire_extinguished and step < last and not lit.get(step):
                    return blocks.voxels(frame)
        else:
            drop(now)
        now = done.where(F.col("step") == at + count) if told else done
        at += count
    if told and not steps and history is not None:
        history.append((first, blocks.voxels(now)))
    return blocks.voxels(now)


def _tell(step: int, frame: DataFrame, listen, history: list | None) -> None:
    table = blocks.voxels(frame)
    if history is not None:
        history.append((step, table))
    if listen:
        listen(step, table)


def snapshots(history: list[tuple[int, DataFrame]]) -> DataFrame:
    """(step, x, y, z, state, fuel) of recorded steps."""
    out = None
    for step, table in history:
        rows = table.withColumn("step", F.lit(step))
        out = rows if out is None else out.unionByName(rows)
    return out


def statistics(snaps: DataFrame, resolution: float = 5.0) -> DataFrame:
    """(step, z, unburned, burning, burned and their areas); z null is the sum over layers."""
    area = F.lit(resolution * resolution)
    counts = [F.count_if(F.col("state") == s).alias(n) for s, n in ((UNBURNED, "unburned"), (BURNING, "burning"), (BURNED, "burned"))]
    out = snaps.rollup("step", "z").agg(*counts).where("step IS NOT NULL")
    return out.select("step", "z", "unburned", "burning", "burned", *[(F.col(n) * area).alias(f"{n}_area") for n in ("unburned", "burning", "burned")])


def wide_statistics(stats: DataFrame, layers: int) -> DataFrame:
    """One row for each step with totals and three columns for each layer."""
    total = stats.where("z IS NULL").select("step", "burning", "burned", "unburned", ((F.col("burning") + F.col("burned")) / (F.col("burning") + F.col("burned") + F.col("unburned")) * 100).alias("burned_percent"))
    share = (F.first("burned") + F.first("burning")) / (F.first("burned") + F.first("burning") + F.first("unburned")) * 100
    by_layer = stats.where("z IS NOT NULL").groupBy("step").pivot("z", list(range(layers))).agg(F.first("burning").alias("burning"), F.first("burned").alias("burned"), share.alias("percent"))
    return total.join(by_layer, "step")


def composite(state: DataFrame) -> DataFrame:
    """(x, y, state): the highest state over the layers."""
    return state.groupBy("x", "y").agg(F.max("state").alias("state"))


def peak(stats: DataFrame) -> DataFrame:
    """(peak_step, peak_burning): the first step with the most burning voxels."""
    return stats.where("z IS NULL").agg(F.max_by("step", F.struct("burning", -F.col("step"))).alias("peak_step"), F.max("burning").alias("peak_burning"))


def report(state: DataFrame, resolution: float = 5.0) -> DataFrame:
    """(burned_area, burned_percent, hectares, pattern) of burning and burned columns of cells."""
    cells = composite(state)
    out = cells.agg(F.count_if(F.col("state") > 0).alias("hit"), F.count("*").alias("cells"))
    out = out.select((F.col("hit") * resolution * resolution).alias("burned_area"), (F.col("hit") / F.col("cells") * 100).alias("burned_percent"))
    return out.select("*", (F.col("burned_area") / 10000).alias("hectares"), fire.burn_pattern(F.col("burned_percent")).alias("pattern"))


def bounding_box(state: DataFrame, width: int, height: int, margin: int = 5) -> DataFrame:
    """Box of voxels that burn or burned, with a margin, clipped to the grid."""
    hit = state.where(F.col("state") > 0)
    return hit.agg(F.greatest(F.lit(0), F.min("x") - margin).alias("x_min"), F.least(F.lit(width - 1), F.max("x") + margin).alias("x_max"), F.greatest(F.lit(0), F.min("y") - margin).alias("y_min"), F.least(F.lit(height - 1), F.max("y") + margin).alias("y_max"))


#: Steps between full states by level of history compression.
KEYFRAMES = {0: 1, 1: 5, 2: 10, 3: 20}


def compress(snaps: DataFrame, level: int) -> DataFrame:
    """(step, kind, x, y, z, state): full states of burning and burned voxels at keyframes, changes between."""
    every = KEYFRAMES[level]
    before = F.lag("state").over(Window.partitionBy(*spread.KEY).orderBy("step"))
    marked = snaps.select("step", *spread.KEY, "state", F.coalesce(before, F.lit(UNBURNED)).alias("before"), (F.col("step") % every == 0).alias("key"))
    kept = marked.where((F.col("key") & (F.col("state") > 0)) | (F.col("state") != F.col("before")))
    return kept.select("step", F.when(F.col("key"), "keyframe").otherwise("delta").alias("kind"), *spread.KEY, "state")


def changes(snaps: DataFrame) -> DataFrame:
    """(step, x, y, z, before, state) of voxels that changed since the step before."""
    before = F.lag("state").over(Window.partitionBy(*spread.KEY).orderBy("step"))
    return snaps.withColumn("before", before).where("before <> state").select("step", *spread.KEY, "before", "state")


def state_at(history: DataFrame, voxels: DataFrame, step: int) -> DataFrame:
    """(x, y, z, state) at a step: the latest record of each voxel up to it, else unburned.

    A history with a column `keyframe` (see store.write_compressed) is read from the last
    keyframe on, so what is read does not grow with the steps before it.
    """
    if "keyframe" in history.columns:
        keys = [r[0] for r in history.select("keyframe").distinct().collect() if r[0] <= step]  # a number for each keyframe
        history = history.where(F.col("keyframe") == (max(keys) if keys else None))
    latest = history.where(F.col("step") <= step).groupBy(*spread.KEY).agg(F.max_by("state", "step").alias("state"))
    return voxels.select(spread.KEY).join(latest, spread.KEY, "left").withColumn("state", F.coalesce("state", F.lit(UNBURNED)))


def ensemble(runs: DataFrame) -> DataFrame:
    """(x, y, burn_probability, first_arrival) from snapshots with a run number."""
    hit = runs.groupBy("run", "x", "y").agg(F.max(F.when(F.col("state") > 0, 1).otherwise(0)).alias("hit"), F.min(F.when(F.col("state") > 0, F.col("step"))).alias("arrival"))
    return hit.groupBy("x", "y").agg(F.avg("hit").alias("burn_probability"), F.min("arrival").alias("first_arrival"))


def overlay(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """Agreement of two masks (x, y, burned): counts, Jaccard and Sorensen indices."""
    both = simulated.select("x", "y", F.col("burned").alias("s")).join(observed.select("x", "y", F.col("burned").alias("o")), ["x", "y"], "full_outer").select(F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("o", F.lit(0)).alias("o"))
    out = both.agg(*[F.sum(F.when((F.col("s") == a) & (F.col("o") == b), 1).otherwise(0)).alias(n) for n, a, b in (("hits", 1, 1), ("false_alarms", 1, 0), ("misses", 0, 1))])
    hits, rest = F.col("hits"), F.col("false_alarms") + F.col("misses")
    return out.select("*", (hits / (hits + rest)).alias("jaccard"), (F.lit(2) * hits / (F.lit(2) * hits + rest)).alias("sorensen"))


def perimeter(mask: DataFrame) -> DataFrame:
    """(edges, area, centre_x, centre_y, shape) of the cells of a mask (x, y)."""
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in fire.NEIGHBOURS[:4]])
    open_ = mask.select("x", "y", F.inline(sides)).select((F.col("x") + F.col("i")).alias("x"), (F.col("y") + F.col("j")).alias("y")).join(mask.select("x", "y"), ["x", "y"], "left_anti")
    edges = open_.agg(F.count("*").alias("edges"))
    area = mask.agg(F.count("*").alias("area"), F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"))
    return edges.join(area).select("edges", "area", "centre_x", "centre_y", (F.col("edges") / (F.lit(4.0) * F.sqrt("area"))).alias("shape"))
