"""The quadtree, its nearest join and the triangulated ground against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import joins, quadtree, tin

rng = np.random.default_rng(7)


def frame(spark, rows, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names.split()))


def clouds(kind):
    if kind == "even":
        return rng.uniform(0, 1, (700, 2))
    if kind == "grid":
        return np.array(list(itertools.product(range(24), repeat=2)), float)
    if kind == "two sites":
        return np.r_[rng.uniform(0, 1, (400, 2)), rng.uniform(0, 1, (400, 2)) + [1000, 300], rng.uniform(0, 1200, (15, 2))]
    turn = rng.uniform(0, 2 * np.pi, 200)
    return np.r_[np.c_[np.cos(turn), np.sin(turn)] * 10, rng.uniform(-1, 1, (400, 2))]


@pytest.mark.parametrize("kind", ["even", "grid", "two sites", "ring"])
def test_nearest_equals_brute_force(spark, kind):
    g = clouds(kind)
    z = rng.integers(0, 9, len(g))
    low, high = g.min(axis=0), g.max(axis=0)
    q = np.r_[rng.uniform(low - (high - low) / 2, high + (high - low) / 2, (300, 2)), g[:200] + rng.normal(0, 0.05, (200, 2)), g[:20]]
    ground = frame(spark, np.c_[g, z], "gx gy gz")
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "_row long, x double, y double")
    found = {r._row: r.near for r in quadtree.nearest(asked, ground).collect()}
    assert len(found) == len(q)
    d = np.sqrt((q[:, None, 0] - g[None, :, 0]) ** 2 + (q[:, None, 1] - g[None, :, 1]) ** 2)
    for i in range(len(q)):
        assert found[i].d == pytest.approx(d[i].min(), abs=1e-12)
        assert found[i].gz == min(z[np.isclose(d[i], d[i].min(), rtol=0, atol=1e-13)])


def test_leaves_cover_the_square_once_and_hold_few(spark):
    points = frame(spark, clouds("two sites"), "x y")
    f, n = quadtree.frame_of(points)
    tree = quadtree.nodes(points, f, n, 10)
    leaves = tree.where("leaf")
    assert leaves.agg(F.sum(F.pow(F.lit(4.0), -F.col("level")))).first()[0] == pytest.approx(1.0)
    assert leaves.agg(F.max("n"), F.sum("n")).first() == (10, n) or leaves.agg(F.max("n")).first()[0] <= 10
    placed = quadtree.located(points, leaves, f)
    assert placed.count() == n and placed.groupBy(*quadtree.KEY).count().agg(F.max("count")).first()[0] <= 10


def test_repeated_points_end_at_the_finest_level(spark):
    points = frame(spark, [(0, 0)] * 50 + [(1, 1)], "x y")
    f, n = quadtree.frame_of(points)
    top = quadtree.nodes(points, f, n, 10).where("leaf").agg(F.max("n"), F.max("level")).first()
    assert tuple(top) == (50, quadtree.DEEPEST)


def test_two_far_sites_cost_a_point_what_one_does(spark):
    """Ground points that a point meets in its leaf's list, for one site and for two that are 100 km apart."""
    site = rng.uniform(0, 1000, (4000, 2))
    costs = []
    for g in (site, np.r_[site, site + [100_000, 0]]):
        points = frame(spark, g, "x y")
        f, n = quadtree.frame_of(points)
        leaves = quadtree.nodes(points, f, n, quadtree.NEAREST_ROWS).where("leaf")
        around = quadtree.in_windows(points, leaves, f).groupBy(*quadtree.KEY).agg(F.count("*").alias("m"))
        around = around.where(F.col("m") <= quadtree.WINDOW_LEAVES * quadtree.NEAREST_ROWS)
        costs.append(quadtree.located(points, leaves, f).join(around, quadtree.KEY).agg(F.avg("m")).first()[0])
    assert costs[1] < 1.3 * costs[0]


def test_heights_of_odd_rows(spark):
    points = spark.createDataFrame([(1, 0.4, 0.0, 5.0), (2, None, 0.0, 5.0), (3, float("nan"), 0.0, 5.0), (4, 9.0, 9.0, None), (1, 0.4, 0.0, 5.0)], "id int, x double, y double, z double")
    ground = frame(spark, [(0, 0, 1), (1, 0, 2), (0, 0, 0.5)], "x y z")
    found = sorted(map(str, (tuple(r) for r in joins.normalise_heights(points.withColumn("near", F.lit(7)), ground).select("id", "near", "hag").collect())))
    assert found == sorted(map(str, [(1, 7, 4.5), (1, 7, 4.5), (2, 7, None), (3, 7, None), (4, 7, None)]))


def local(points):
    mesh = tin.triangulated(points[:, 0], points[:, 1])
    return set(mesh.triangles()) if mesh else set()


@pytest.mark.parametrize("turn", range(12))
def test_a_mesh_holds_the_triangles_with_empty_circles(turn):
    n = int(rng.integers(3, 20))
    points = [rng.uniform(0, 1, (n, 2)), rng.integers(0, 4, (n, 2)).astype(float), rng.integers(0, 3, (n, 2)) * 0.1 + 0.7][turn % 3]
    points = np.unique(points, axis=0)
    mesh, expected = tin.Mesh(points[:, 0].tolist(), points[:, 1].tolist()), set()
    for a, b, c in itertools.combinations(range(len(points)), 3):
        side = mesh.orient(a, b, c)
        if side and all(not mesh.inside(*((a, b, c) if side > 0 else (a, c, b)), p) for p in range(len(points)) if p not in (a, b, c)):
            expected.add((a, b, c) if side > 0 else (a, c, b))
    assert local(points) == expected


@pytest.mark.parametrize(("kind", "rows"), [("even", 60), ("grid", 60), ("two sites", 50), ("ring", 80)])
def test_leaves_agree_with_one_mesh(spark, kind, rows):
    """Many leaves give the triangles of a single triangulation, each once, cocircular points included."""
    points = np.unique(clouds(kind), axis=0)
    ground = frame(spark, np.c_[points, np.arange(len(points))], "x y z")
    found = [tuple(int(r[f"{p}z"]) for p in "abc") for r in tin.triangulate(ground, rows).collect()]
    least = lambda t: min((t, t[1:] + t[:1], t[2:] + t[:2]))
    assert len(found) == len(set(found)) and {least(t) for t in found} == local(points)


def test_heights_over_the_triangles(spark):
    plane = lambda x, y: 3 + 2 * x - 0.5 * y
    g = rng.uniform(0, 100, (300, 2))
    ground = frame(spark, np.c_[g, plane(*g.T)], "x y z")
    q = rng.uniform(20, 80, (400, 2))
    rows = [(i, float(x), float(y), float(plane(x, y) + i)) for i, (x, y) in enumerate(q)] + [(-1, 500.0, 0.0, 1.0), (-2, None, 1.0, 1.0), (-3, *map(float, g[0]), 50.0)]
    found = {r.id: r for r in tin.normalise_by_tin(spark.createDataFrame(rows, "id int, x double, y double, z double"), ground, 40).collect()}
    assert len(found) == len(rows)
    assert all(found[i].hag == pytest.approx(i, abs=1e-6) for i in range(400))
    assert found[-1].hag is None and found[-2].ground is None and found[-3].ground == pytest.approx(plane(*g[0]))


@pytest.mark.parametrize("rows", [[], [(0, 0, 1)], [(0, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 2)], [(0, 0, 1)] * 5])
def test_no_triangle(spark, rows):
    ground = frame(spark, rows, "x y z")
    assert tin.triangulate(ground, 2).count() == 0
    asked = frame(spark, [(0.5, 0.5, 2)], "x y z")
    assert tin.normalise_by_tin(asked, ground, 2).first().hag is None
