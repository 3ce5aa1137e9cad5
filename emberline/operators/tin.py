"""Triangulated ground: a Delaunay triangulation of any number of points, and heights over it.

Leaves of a quadtree, each with a rim, are triangulated apart.  A triangle is certain if its
circumcircle lies within leaf and rim, for then no point elsewhere can be in it, and a vertex
is settled if all triangles around it are certain.  What is missing then has unsettled
vertices only, and whether such a triangle holds is decided by them and their known
neighbours (a circle through a vertex that has any point inside has a neighbour of that
vertex inside).  So the next round works on these few points, with leaves that fit them,
and the last one on what a single leaf holds.

Four points on one circle have two triangulations.  Everywhere the one counts that has an
edge at the first of them in order of (x, y), so leaves agree; signs are exact.
"""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators import quadtree
from emberline.scratch import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: points of a leaf, at most; of a leaf and its rim, in leaves
LEAF_ROWS = 2_000
WINDOW_LEAVES = 3
#: the rim, in widths of the leaf
RIM = 0.2
CORNERS = [f"{p}{c}" for p in "abc" for c in "xyz"]
FOUND = ", ".join(f"{c} double" for c in CORNERS) + ", kind int"
#: kinds of rows of a leaf: a triangle that no other leaf finds and whose vertices are settled, another, an unsettled vertex
INNER, SHARED, OPEN = 0, 1, 2
GHOST = -1


class Mesh:
    """A Delaunay triangulation that grows point by point.  Beyond each hull edge lies a triangle with the ghost."""

    def __init__(self, x: list[float], y: list[float]):
        self.x, self.y = x, y
        #: the third vertex of the triangle on the left of each directed edge
        self.third: dict[tuple[int, int], int] = {}
        self.last: tuple[int, int, int] | None = None

    def orient(self, a: int, b: int, c: int) -> int:
        """1 if c lies on the left of a to b, -1 on the right, 0 on the line."""
        x, y = self.x, self.y
        left, right = (x[b] - x[a]) * (y[c] - y[a]), (y[b] - y[a]) * (x[c] - x[a])
        d = left - right
        if abs(d) > 3.5e-16 * (abs(left) + abs(right)):
            return 1 if d > 0 else -1
        ax, ay, bx, by, cx, cy = (Fraction(v[i]) for i in (a, b, c) for v in (x, y))
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        return (d > 0) - (d < 0)

    def inside(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p lies in the circle of the triangle a, b, c; on it, whether it or the edge across comes first."""
        x, y = self.x, self.y
        ax, ay, bx, by, cx, cy = x[a] - x[p], y[a] - y[p], x[b] - x[p], y[b] - y[p], x[c] - x[p], y[c] - y[p]
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, cb, ca, ac, ab, ba = bx * cy, by * cx, cx * ay, cy * ax, ax * by, ay * bx
        d = aa * (bc - cb) + bb * (ca - ac) + cc * (ab - ba)
        if abs(d) > 1.2e-15 * (aa * (abs(bc) + abs(cb)) + bb * (abs(ca) + abs(ac)) + cc * (abs(ab) + abs(ba))):
            return d > 0
        ax, ay, bx, by, cx, cy = (Fraction(v[i]) - Fraction(v[p]) for i in (a, b, c) for v in (x, y))
        d = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if d:
            return d > 0
        place = lambda i: (x[i], y[i])
        first = min((a, b, c, p), key=place)
        if first == p:
            return True
        while a != first:
            a, b, c = b, c, a
        return self.orient(b, c, p) < 0

    def beyond(self, u: int, v: int, p: int) -> bool:
        """Whether p is outside of the hull edge v to u, or on it."""
        side = self.orient(u, v, p)
        if side:
            return side > 0
        place = lambda i: (self.x[i], self.y[i])
        return min(place(u), place(v)) < place(p) < max(place(u), place(v))

    def conflict(self, a: int, b: int, c: int, p: int) -> bool:
        if c == GHOST:
            return self.beyond(a, b, p)
        if a == GHOST:
            return self.beyond(b, c, p)
        if b == GHOST:
            return self.beyond(c, a, p)
        return self.inside(a, b, c, p)

    def add(self, a: int, b: int, c: int) -> None:
        self.third[a, b] = c
        self.third[b, c] = a
        self.third[c, a] = b

    def start(self, a: int, b: int, c: int) -> None:
        if self.orient(a, b, c) < 0:
            b, c = c, b
        self.add(a, b, c)
        for u, v in ((b, a), (c, b), (a, c)):
            self.add(u, v, GHOST)
        self.last = (a, b, c)

    def around(self, p: int) -> tuple[int, int, int]:
        """A triangle that p is in conflict with, by walking towards it."""
        a, b, c = self.last
        while True:
            for u, v, w in ((a, b, c), (b, c, a), (c, a, b)):
                if self.orient(u, v, p) < 0:
                    x = self.third[v, u]
                    if x == GHOST:
                        return v, u, GHOST
                    a, b, c = v, u, x
                    break
            else:
                return a, b, c

    def insert(self, p: int) -> None:
        third = self.third
        a, b, c = self.around(p)
        open_edges, border = [(a, b), (b, c), (c, a)], []
        for e in open_edges:
            del third[e]
        while open_edges:
            u, v = open_edges.pop()
            x = third[v, u]
            if self.conflict(v, u, x, p):
                del third[v, u], third[u, x], third[x, v]
                open_edges += [(u, x), (x, v)]
            else:
                border.append((u, v))
        for u, v in border:
            self.add(u, v, p)
            if u != GHOST and v != GHOST:
                self.last = (u, v, p)

    def triangles(self):
        """Each once, from its smallest vertex; ghosts are left out."""
        for (a, b), c in self.third.items():
            if GHOST < a < b and a < c:
                yield a, b, c

    def hull(self) -> list[tuple[int, int]]:
        """Edges (u, v) with the outside on their left."""
        return [e for e, c in self.third.items() if c == GHOST]


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order in which neighbours follow each other."""
    code = np.zeros(len(x), np.int64)
    unit = lambda v: ((v - v.min()) / (np.ptp(v) or 1.0) * 65535).astype(np.int64)
    i, j = unit(x), unit(y)
    for bit in range(16):
        code |= ((i >> bit) & 1) << (2 * bit + 1) | ((j >> bit) & 1) << (2 * bit)
    return np.argsort(code, kind="stable")


def triangulated(x: np.ndarray, y: np.ndarray) -> Mesh | None:
    """The mesh of distinct points; None if all are on one line."""
    mesh = Mesh(x.tolist(), y.tolist())
    order = _curve(x, y).tolist()
    if len(order) < 3:
        return None
    a, b = order[:2]
    at = next((k for k in range(2, len(order)) if mesh.orient(a, b, order[k])), None)
    if at is None:
        return None
    mesh.start(a, b, order[at])
    for k, p in enumerate(order):
        if k > 1 and k != at:
            mesh.insert(p)
    return mesh


def _outside(x, y, u: int, v: int, box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """Corners of what lies strictly left of u to v within a box."""
    a, b, c, d = box
    corners = [(a, c), (b, c), (b, d), (a, d)]
    side = [(x[v] - x[u]) * (q - y[u]) - (y[v] - y[u]) * (p - x[u]) for p, q in corners]
    out = []
    for k in range(4):
        (p, q), (r, s), m, n = corners[k], corners[(k + 1) % 4], side[k], side[(k + 1) % 4]
        if m > 0:
            out.append((p, q))
        if (m > 0) != (n > 0) and m != n:
            out.append((p + (r - p) * m / (m - n), q + (s - q) * m / (m - n)))
    return out if any(s > 0 for s in side) else []


def _leaf(frame: quadtree.Frame, rim: float, box: tuple[float, float, float, float], last: bool):
    """Triangles and unsettled vertices of a leaf.  box: where there are points at all."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"], kind="stable")
        x, y, z = (rows[c].to_numpy() for c in "xyz")
        own, asked = rows["own"].to_numpy(), rows["asked"].to_numpy()
        rimmed = rim if not own.all() or last else 0.0
        mesh = triangulated(x, y)
        place = np.stack([x, y, z], axis=1)
        if mesh is None:
            found, settled = np.zeros((0, 3), np.int64), np.full(len(x), last)
        else:
            found = np.array(sorted(mesh.triangles()), np.int64).reshape(-1, 3)
            settled = np.full(len(x), True)
            if not last:
                level, ix, iy = key
                a, b, c, d = frame.box(level, ix, iy)
                rim_width = rimmed * (b - a)
                west, east, south, north = a - rim_width, b + rim_width, c - rim_width, d + rim_width
                west, south = (-np.inf if w <= low else w for w, low in ((west, box[0]), (south, box[2])))
                east, north = (np.inf if e >= high else e for e, high in ((east, box[1]), (north, box[3])))
                within = lambda x0, x1, y0, y1: (x0 > west) & (x1 < east) & (y0 > south) & (y1 < north)
                p, q, r = (place[found[:, k], :2] for k in range(3))
                u, v = q - p, r - p
                cross = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
                uu, vv = (u**2).sum(axis=1), (v**2).sum(axis=1)
                with np.errstate(all="ignore"):
                    cx, cy = (v[:, 1] * uu - u[:, 1] * vv) / cross, (u[:, 0] * vv - v[:, 0] * uu) / cross
                    size = np.hypot(cx, cy) * (1 + 1e-6)
                    sure = within(p[:, 0] + cx - size, p[:, 0] + cx + size, p[:, 1] + cy - size, p[:, 1] + cy + size)
                settled[found[~sure].ravel()] = False
                for u, v in mesh.hull():
                    if settled[u] or settled[v]:
                        if not all(within(px, px, py, py) for px, py in _outside(mesh.x, mesh.y, u, v, box)):
                            settled[[u, v]] = False
        core = own & asked
        settled &= core
        some = found[settled[found].any(axis=1) & asked[found].all(axis=1)] if not last else found[asked[found].all(axis=1)]
        inner = settled[some].all(axis=1) if len(some) else np.zeros(0, bool)
        open_ones = np.flatnonzero(core & ~settled)
        out = np.full((len(some) + len(open_ones), 9), np.nan)
        out[: len(some)] = place[some].reshape(-1, 9)
        out[len(some) :, :3] = place[open_ones]
        kind = np.r_[np.where(inner, INNER, SHARED), np.full(len(open_ones), OPEN)]
        return pd.DataFrame(out, columns=CORNERS).assign(kind=kind.astype(np.int32))

    return run


def _vertex(p: str) -> Column:
    return F.struct(*[F.col(f"{p}{c}").alias(c) for c in "xyz"])


def triangulate(ground: DataFrame, rows: int = LEAF_ROWS) -> DataFrame:
    """(ax, ay, az, bx, by, bz, cx, cy, cz): the Delaunay triangles of ground points (x, y, z), corners counter-clockwise from the first in order of (x, y).

    Of points at one place the lowest counts; points whose x or y is not a number, or with
    a null z, are left out.  Fewer than three places, or places on one line, have no
    triangle.
    """
    sound = F.lit(True)
    for c in "xyz":
        sound = sound & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    # negative zero is zero
    places = ground.where(sound).groupBy(*[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in "xy"]).agg(F.min(F.col("z").cast("double")).alias("z"))
    now = stage(places.withColumn("asked", F.lit(True)), "ground")
    box, done, shared = now.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first(), [], []
    while True:
        frame, n = quadtree.frame_of(now)
        last = n <= rows
        if last:
            dealt = now.withColumns({"level": F.lit(0), "ix": F.lit(0), "iy": F.lit(0), "own": F.lit(True)})
        else:
            leaves = quadtree.nodes(now, frame, n, rows).where("leaf AND n > 0")
            placed = stage(quadtree.in_windows(now, leaves, frame, RIM), "tin-windows")
            crowded = placed.groupBy(*quadtree.KEY).agg(F.count("*").alias("m")).where(F.col("m") > WINDOW_LEAVES * rows).select(*quadtree.KEY, F.lit(True).alias("crowded"))
            # a leaf beside much denser ground does without its rim
            dealt = placed.join(crowded, quadtree.KEY, "left").where("own OR crowded IS NULL").drop("crowded")
        out = stage(dealt.select(*quadtree.KEY, "x", "y", "z", "own", "asked").groupBy(*quadtree.KEY).applyInPandas(_leaf(frame, RIM, tuple(box), last), FOUND), "tin-round")
        done.append(out.where(F.col("kind") == INNER).select(CORNERS))
        shared.append(stage(out.where(F.col("kind") == SHARED).select(CORNERS).distinct(), "tin-shared"))
        if last:
            break
        left = out.where(F.col("kind") == OPEN).select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z")).distinct()
        corners = _union(shared).withColumn("v", F.explode(F.array(*[_vertex(p) for p in "abc"])))
        touching = corners.join(left.select(F.struct("x", "y", "z").alias("v")), "v", "left_semi").select(CORNERS).distinct()
        beside = touching.select(F.explode(F.array(*[_vertex(p) for p in "abc"])).alias("v")).distinct().select("v.x", "v.y", "v.z").join(left, ["x", "y"], "left_anti")
        now = stage(left.withColumn("asked", F.lit(True)).unionByName(beside.withColumn("asked", F.lit(False))), "tin-open")
        if now.isEmpty():
            break
        rows *= 2
    return _union([*done, *shared])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def heights(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points (x, y, z, ...) with ground, the height of the triangle that they are in, and hag, their height over it.

    A triangle is listed in the cells, four at most, of a grid as wide as itself, and a
    point looks itself up in the grids there are.  On an edge either triangle gives the
    same height.  Both columns are null outside of all triangles and for points whose x or
    y is not a number; columns of these names are replaced.
    """
    points = points.drop("ground", "hag")
    wide = [F.greatest(*[F.col(f"{p}{c}") for p in "abc"]) - F.least(*[F.col(f"{p}{c}") for p in "abc"]) for c in "xy"]
    # no narrower than most triangles, so that nearly all are in one grid
    usual = triangles.agg(F.percentile_approx(F.greatest(*wide), 0.9, 1000)).first()[0] or 1.0
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*wide) / F.lit(usual)))).cast("int")
    w = F.lit(usual) * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda v: F.floor(v / w).cast("long")
    span = [F.sequence(cell(F.least(*[F.col(f"{p}{c}") for p in "abc"])), cell(F.greatest(*[F.col(f"{p}{c}") for p in "abc"]))) for c in "xy"]
    listed = stage(triangles.withColumn("level", level).withColumn("gx", F.explode(span[0])).withColumn("gy", F.explode(span[1])), "listed")
    levels = [r[0] for r in listed.select("level").distinct().collect()]  # powers of two between triangles
    numbered = stage(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    sound = (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf"))
    asked = numbered.where(sound).select("_row", "x", "y", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")).alias("level"))
    met = asked.withColumns({"gx": cell(F.col("x")), "gy": cell(F.col("y"))}).join(listed, ["level", "gx", "gy"])
    x, y = F.col("x"), F.col("y")
    turn = lambda p, q: (F.col(f"{q}x") - F.col(f"{p}x")) * (y - F.col(f"{p}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (x - F.col(f"{p}x"))
    whole = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    met = met.withColumns({"wa": turn("b", "c") / whole, "wb": turn("c", "a") / whole, "wc": turn("a", "b") / whole})
    within = F.least("wa", "wb", "wc")
    height = F.col("wa") * F.col("az") + F.col("wb") * F.col("bz") + F.col("wc") * F.col("cz")
    best = met.where(within >= -1e-9).groupBy("_row").agg(F.max(F.struct(within.alias("within"), height.alias("ground"))).alias("best"))
    out = numbered.join(best, "_row", "left").withColumn("ground", F.col("best.ground")).withColumn("hag", F.col("z") - F.col("ground"))
    return out.drop("_row", "best")


def normalise_by_tin(points: DataFrame, ground: DataFrame, rows: int = LEAF_ROWS) -> DataFrame:
    """points with their height over the triangulated ground, see triangulate and heights."""
    return heights(points, stage(triangulate(ground, rows), "triangles"))
