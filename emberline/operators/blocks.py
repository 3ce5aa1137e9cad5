"""Many steps of fire spread at once, block by block.

The grid is a table with one row for each block of columns, the values of its voxels packed
as arrays.  What a voxel does in a step depends on voxels at most `reach` away, and every
draw depends on its key alone, so a task that holds a block and a rim of `steps` times
`reach` works out that many steps of the block without asking anybody: only rims move, once
a round.  Blocks without fire in their block or rim are left as they are and move nothing.

Within a block a step touches burning voxels and their targets.  The formulas are those of
`functions.fire`, and `operators.spread` has the same step as plain joins.
"""

from __future__ import annotations

import hashlib
import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from emberline.functions.fire import NEIGHBOURS
from emberline.schema import BURNED, BURNING, UNBURNED
from emberline.scratch import drop, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: voxels of a block, about
BLOCK_VOXELS = 1 << 18
#: rim of a block, at most as many columns as the block is wide
STATIC = ("conn_up", "moisture", "u", "v", "dir", "speed")
BLOCK = "step int, bx int, by int, x0 int, y0 int, w int, h int, burning long, state binary, fuel binary, static binary"
VOXELS = "x int, y int, z int, state int, fuel double"
#: no voxel here
ABSENT = -1


@dataclass
class Rules:
    """The numbers of a configuration that a step needs."""

    width: int
    height: int
    layers: int
    open_edge: bool
    y_sign: int
    values: dict

    def __getattr__(self, name: str):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def reach(self) -> int:
        """Columns that a step can look or throw across."""
        return 1 + (2 * self.ember_distance if self.ember_probability > 0 else 0)


NEEDED = (
    "random_seed", "num_layers", "fuel_consumption_rate", "wind_effect_max", "diagonal_factor", "sigmoid_steepness", "sigmoid_threshold", "spread_threshold", "canopy_start_layer", "crown_multiplier",
    "downward_spread", "ember_probability", "embers_per_cell", "ember_distance", "ember_rise", "ember_ignition", "ember_min_probability", "ember_vertical_penalty", "ember_fuel_multiplier",
)


def rules(c, width: int, height: int, layers: int, open_edge: bool = False, y_sign: int = 1) -> Rules:
    return Rules(width, height, layers, open_edge, y_sign, {n: getattr(c, n) for n in NEEDED})


def _uniform(prefix: str, columns: list[np.ndarray], suffix: str = "") -> np.ndarray:
    """The draws of functions.rng.uniform, key by key."""
    md5, out = hashlib.md5, bytearray()
    for key in zip(*(c.tolist() for c in columns), strict=True):
        out += md5((prefix + ":".join(map(str, key)) + suffix).encode()).digest()[:4]
    return np.frombuffer(bytes(out), ">u4") / 4294967296.0


class Region:
    """Arrays [z, y, x] of a box of columns."""

    def __init__(self, x0: int, y0: int, w: int, h: int, layers: int):
        self.x0, self.y0, self.w, self.h, self.layers = x0, y0, w, h, layers
        self.state = np.full((layers, h, w), ABSENT, np.int8)
        self.fuel = np.zeros((layers, h, w))
        self.static = np.full((len(STATIC), layers, h, w), np.nan)

    @classmethod
    def of(cls, x0: int, y0: int, w: int, h: int, state: bytes, fuel: bytes, static: bytes) -> Region:
        out = cls.__new__(cls)
        layers = len(state) // (w * h)
        out.x0, out.y0, out.w, out.h, out.layers = x0, y0, w, h, layers
        out.state = np.frombuffer(state, np.int8).reshape(layers, h, w)
        out.fuel = np.frombuffer(fuel).reshape(layers, h, w)
        out.static = np.frombuffer(static).reshape(len(STATIC), layers, h, w)
        return out

    def part(self, x0: int, y0: int, x1: int, y1: int) -> Region | None:
        """What lies in the box (ends exclusive), if anything does."""
        x0, y0, x1, y1 = max(x0, self.x0), max(y0, self.y0), min(x1, self.x0 + self.w), min(y1, self.y0 + self.h)
        if x0 >= x1 or y0 >= y1:
            return None
        out = Region.__new__(Region)
        out.x0, out.y0, out.w, out.h, out.layers = x0, y0, x1 - x0, y1 - y0, self.layers
        at = (..., slice(y0 - self.y0, y1 - self.y0), slice(x0 - self.x0, x1 - self.x0))
        out.state, out.fuel, out.static = self.state[at], self.fuel[at], self.static[at]
        return out

    def put(self, other: Region) -> None:
        at = (..., slice(other.y0 - self.y0, other.y0 - self.y0 + other.h), slice(other.x0 - self.x0, other.x0 - self.x0 + other.w))
        self.state[at], self.fuel[at], self.static[at] = other.state, other.fuel, other.static

    def row(self, step: int, bx: int, by: int) -> dict:
        burning = int(np.count_nonzero(self.state == BURNING))
        return {"step": step, "bx": bx, "by": by, "x0": self.x0, "y0": self.y0, "w": self.w, "h": self.h, "burning": burning, "state": self.state.tobytes(), "fuel": self.fuel.tobytes(), "static": self.static.tobytes()}


def _acting(r: Region, c: Rules) -> tuple[np.ndarray, ...]:
    """(z, y, x) of burning voxels that act: those off the edge of the grid, unless it is open."""
    z, y, x = np.nonzero(r.state == BURNING)
    if c.open_edge:
        return z, y, x
    gx, gy = x + r.x0, y + r.y0
    inner = (gx >= 1) & (gx <= c.width - 2) & (gy >= 1) & (gy <= c.height - 2)
    return z[inner], y[inner], x[inner]


def _targets(r: Region, z, y, x) -> np.ndarray:
    """Which voxels are in the region, unburned and with fuel."""
    ok = (z >= 0) & (z < r.layers) & (y >= 0) & (y < r.h) & (x >= 0) & (x < r.w)
    at = tuple(i[ok] for i in (z, y, x))
    ok[ok] = (r.state[at] == UNBURNED) & (r.fuel[at] > 0)
    return ok


def _horizontal(r: Region, step: int, c: Rules) -> None:
    z, y, x = _acting(r, c)
    conn, moisture, u, v = r.static[:4]
    left = r.fuel[z, y, x] - c.fuel_consumption_rate * (1.0 - 0.5 * z / c.num_layers)
    on = left > 0
    sz, sy, sx = z[on], y[on], x[on]
    lit_z, lit_y, lit_x = np.nonzero(r.state == BURNING)
    near: dict[int, np.ndarray] = {}
    for layer in np.unique(sz).tolist():
        padded = np.zeros((r.h + 2, r.w + 2), np.int8)
        here = lit_z == layer
        for dx, dy in NEIGHBOURS:
            np.add.at(padded, (lit_y[here] + dy + 1, lit_x[here] + dx + 1), 1)
        near[layer] = padded[1:-1, 1:-1]
    lit = []
    for dx, dy in NEIGHBOURS:
        ty, tx = sy + dy, sx + dx
        ok = _targets(r, sz, ty, tx)
        az, ay, ax, by, bx = sz[ok], sy[ok], sx[ok], ty[ok], tx[ok]
        if not len(az):
            continue
        n = np.empty(len(az))
        for layer in np.unique(az).tolist():
            own = az == layer
            n[own] = near[layer][by[own], bx[own]]
        wind = np.maximum(0.0, (u[az, ay, ax] * dx - v[az, ay, ax] * dy) / math.sqrt(dx * dx + dy * dy)) * c.wind_effect_max
        p = 1.0 / (1.0 + np.exp(-c.sigmoid_steepness * (n - c.sigmoid_threshold))) * r.fuel[az, by, bx] * (1.0 + wind) * (1.0 - moisture[az, by, bx])
        p = np.clip(p * (c.diagonal_factor if dx and dy else 1.0), 0.0, 1.0)
        k = np.flatnonzero(p > c.spread_threshold)
        draw = _uniform(f"{c.random_seed}:{step}:h:", [ax[k] + r.x0, ay[k] + r.y0, az[k], bx[k] + r.x0, by[k] + r.y0, az[k]])
        k = k[draw < p[k]]
        lit.append((az[k], by[k], bx[k]))
    r.state[z, y, x] = np.where(left <= 0, BURNED, BURNING)
    r.fuel[z, y, x] = np.maximum(0.0, left)
    for at in lit:
        r.state[at] = BURNING


def _vertical(r: Region, step: int, c: Rules) -> None:
    z, y, x = _acting(r, c)
    conn, moisture, u, _, direction, speed = r.static
    lit = []
    known = ~np.isnan(u[z, y, x])
    for dz in (1, -1):
        ok = _targets(r, z + dz, y, x) & known
        az, ay, ax = z[ok], y[ok], x[ok]
        bz = az + dz
        fuel, wet = r.fuel[bz, ay, ax], moisture[bz, ay, ax]
        if dz == 1:
            p = np.clip(conn[az, ay, ax] * (1.0 - wet) * fuel * np.where(az >= c.canopy_start_layer, c.crown_multiplier, 1.0), 0.0, 1.0)
        else:
            p = np.where(np.isnan(wet), np.nan, np.clip(c.downward_spread * fuel, 0.0, 1.0))
        k = np.flatnonzero(p > 0)
        gx, gy = ax[k] + r.x0, ay[k] + r.y0
        k = k[_uniform(f"{c.random_seed}:{step}:v:", [gx, gy, az[k], gx, gy, bz[k]]) < p[k]]
        lit.append((bz[k], ay[k], ax[k]))
    if c.ember_probability > 0:
        lit.append(_embers(r, step, c, z[known], y[known], x[known], direction, speed))
    for at in lit:
        r.state[at] = BURNING


def _embers(r: Region, step: int, c: Rules, z, y, x, direction: np.ndarray, speed: np.ndarray):
    """(z, y, x) that embers light."""
    seed = f"{c.random_seed}:{step}:"
    own = lambda *i: [x[i] + r.x0, y[i] + r.y0, z[i]]
    k = np.flatnonzero(_uniform(f"{seed}e:", own(slice(None))) < c.ember_probability)
    count = 1 + np.floor(_uniform(f"{seed}en:", own(k)) * c.embers_per_cell).astype(np.int64)
    k, number = np.repeat(k, count), np.concatenate([np.arange(1, n + 1) for n in count]) if len(count) else count
    key = [*own(k), number]
    way, wind = direction[z[k], y[k], x[k]], speed[z[k], y[k], x[k]]
    a, b = _uniform(f"{seed}ed:", key, ":angle:a"), _uniform(f"{seed}ed:", key, ":angle:b")
    normal = np.sqrt(-2.0 * np.log(np.maximum(a, 1e-12))) * np.cos(2 * math.pi * b)
    angle = way + math.pi / 4 * np.maximum(0.0, 1.0 - wind) * normal
    base = c.ember_distance
    known = ~np.isnan(angle)
    far = np.where(known, float(base) * (1.0 + wind * np.cos(angle - way)), 0.0)
    distance = np.clip(np.trunc(far).astype(np.int64) + 1, 1, 2 * base)
    deepest = np.minimum(c.ember_rise, z[k])
    fall = np.zeros(len(k), np.int64)
    falls = np.flatnonzero(deepest > 0)
    fall[falls] = -(1 + np.floor(_uniform(f"{seed}ed:", [i[falls] for i in key], ":fall") * deepest[falls]).astype(np.int64))
    turn = np.where(known, angle, 0.0)
    tx = np.trunc(x[k] + r.x0 + distance * np.cos(turn)).astype(np.int64) - r.x0
    ty = np.trunc(y[k] + r.y0 + c.y_sign * distance * np.sin(turn)).astype(np.int64) - r.y0
    tz = z[k] + fall
    ok = np.flatnonzero(_targets(r, tz, ty, tx) & known)
    near = np.maximum(c.ember_min_probability, 1.0 - distance[ok] / float(base))
    deep = np.maximum(c.ember_min_probability, 1.0 - fall[ok] * c.ember_vertical_penalty)
    p = np.clip(c.ember_ignition * near * deep * (1.0 + r.fuel[tz[ok], ty[ok], tx[ok]] * c.ember_fuel_multiplier), 0.0, 1.0)
    ok = ok[_uniform(f"{seed}ei:", [i[ok] for i in key]) < p]
    return tz[ok], ty[ok], tx[ok]


def step_region(r: Region, step: int, c: Rules) -> None:
    """One step: within layers, then between layers and by embers."""
    _horizontal(r, step, c)
    _vertical(r, step, c)


def block_side(layers: int) -> int:
    return max(16, min(512, math.isqrt(BLOCK_VOXELS // max(1, layers))))


def to_blocks(state: DataFrame, static: DataFrame, c: Rules, side: int) -> DataFrame:
    """The blocks of voxels (x, y, z, state, fuel) and what never changes about them; voxels that static lacks spread nothing."""
    joined = state.select("x", "y", "z", F.col("state").cast("int").alias("state"), F.col("fuel").cast("double").alias("fuel")).join(static.select("x", "y", "z", *[F.col(s).cast("double").alias(s) for s in STATIC]), ["x", "y", "z"], "left")
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = joined.withColumns({"bx": F.floor(F.col("x") / side).cast("int"), "by": F.floor(F.col("y") / side).cast("int")})
    dealt = placed.repartition(parts, "bx", "by").sortWithinPartitions("bx", "by")

    def run(batches):
        now, block = None, None
        for b in batches:
            columns = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            bx, by = columns["bx"], columns["by"]
            cuts = np.flatnonzero(np.r_[True, (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])][: len(bx)])
            for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bx)], strict=True):
                if (bx[a], by[a]) != now:
                    if block is not None:
                        yield _rows([block.row(0, *map(int, now))])
                    now = (bx[a], by[a])
                    x0, y0 = int(bx[a]) * side, int(by[a]) * side
                    block = Region(x0, y0, min(side, c.width - x0), min(side, c.height - y0), c.layers)
                at = (columns["z"][a:e], columns["y"][a:e] - block.y0, columns["x"][a:e] - block.x0)
                block.state[at], block.fuel[at] = columns["state"][a:e], columns["fuel"][a:e]
                for k, name in enumerate(STATIC):
                    block.static[(k, *at)] = columns[name][a:e]
        if block is not None:
            yield _rows([block.row(0, *map(int, now))])

    inside = F.col("x").between(0, c.width - 1) & F.col("y").between(0, c.height - 1) & F.col("z").between(0, c.layers - 1)
    return dealt.where(inside).mapInArrow(run, BLOCK)


_KINDS = pa.schema([("step", pa.int32()), ("bx", pa.int32()), ("by", pa.int32()), ("x0", pa.int32()), ("y0", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("burning", pa.int64()), ("state", pa.binary()), ("fuel", pa.binary()), ("static", pa.binary())])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _KINDS)


def _region(row: dict) -> Region:
    return Region.of(row["x0"], row["y0"], row["w"], row["h"], row["state"], row["fuel"], row["static"])


def round_of(blocks: DataFrame, c: Rules, side: int, first: int, steps: int, every: bool) -> DataFrame:
    """Blocks after `steps` steps from step `first`; with `every`, after each of them.

    A block takes part if one that its rim of steps times reach columns can touch burns.
    """
    rim = steps * c.reach
    rings = -(-rim // side)
    offsets = [(i, j) for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)]
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    lit = blocks.where("burning > 0").select("bx", "by", F.inline(around)).select((F.col("bx") + F.col("i")).alias("tx"), (F.col("by") + F.col("j")).alias("ty")).distinct()
    active = stage(lit.join(blocks.select(F.col("bx").alias("tx"), F.col("by").alias("ty")), ["tx", "ty"], "left_semi"), "active")
    asked = active.select("tx", "ty", F.inline(around)).select((F.col("tx") - F.col("i")).alias("ax"), (F.col("ty") - F.col("j")).alias("ay"), F.struct("tx", "ty").alias("to"))
    asked = asked.groupBy("ax", "ay").agg(F.collect_list("to").alias("to"))  # at most as many as offsets
    sent = blocks.join(asked, (F.col("bx") == F.col("ax")) & (F.col("by") == F.col("ay"))).drop("ax", "ay")

    def cut(batches):
        for b in batches:
            for row in b.to_pylist():
                whole = _region(row)
                for to in row["to"]:
                    x0, y0 = to["tx"] * side, to["ty"] * side
                    part = whole.part(x0 - rim, y0 - rim, x0 + side + rim, y0 + side + rim)
                    if part is not None:
                        yield _rows([part.row(row["step"], to["tx"], to["ty"])])

    def work(batches):
        now, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if (row["bx"], row["by"]) != now:
                    yield from advance(now, held)
                    now, held = (row["bx"], row["by"]), []
                held.append(_region(row))
        yield from advance(now, held)

    def advance(now, held):
        if not held:
            return
        x0, y0 = min(p.x0 for p in held), min(p.y0 for p in held)
        region = Region(x0, y0, max(p.x0 + p.w for p in held) - x0, max(p.y0 + p.h for p in held) - y0, held[0].layers)
        for p in held:
            region.put(p)
        own = (now[0] * side, now[1] * side, (now[0] + 1) * side, (now[1] + 1) * side)
        for k in range(steps):
            step_region(region, first + k, c)
            if every or k == steps - 1:
                yield _rows([region.part(*own).row(first + k + 1, *now)])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = sent.mapInArrow(cut, BLOCK).repartition(parts, "bx", "by").sortWithinPartitions("bx", "by").mapInArrow(work, BLOCK)
    idle = blocks.join(active, (F.col("bx") == F.col("tx")) & (F.col("by") == F.col("ty")), "left_anti")
    after = F.explode(F.sequence(F.lit(first + 1), F.lit(first + steps))) if every else F.lit(first + steps)
    out = stage(moved.unionByName(idle.withColumn("step", after)), "blocks")
    drop(active)
    return out


def voxels(blocks: DataFrame) -> DataFrame:
    """(x, y, z, state, fuel) of blocks."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                state = np.frombuffer(row["state"], np.int8).reshape(-1, row["h"], row["w"])
                fuel = np.frombuffer(row["fuel"]).reshape(state.shape)
                for layer in range(len(state)):
                    y, x = np.nonzero(state[layer] != ABSENT)
                    columns = [pa.array((x + row["x0"]).astype(np.int32)), pa.array((y + row["y0"]).astype(np.int32)), pa.array(np.full(len(x), layer, np.int32)), pa.array(state[layer, y, x].astype(np.int32)), pa.array(fuel[layer, y, x])]
                    yield pa.RecordBatch.from_arrays(columns, ["x", "y", "z", "state", "fuel"])

    return blocks.select("x0", "y0", "w", "h", "state", "fuel").mapInArrow(run, VOXELS)
