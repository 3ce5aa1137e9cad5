"""Perimeter rings, fronts and rates of spread; stored histories; region merges of uneven boxes; pyramids of any depth."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import fronts, raster, simulate, tiles
from emberline.sources import store


def mask(spark, cells):
    return spark.createDataFrame([tuple(map(int, c)) for c in cells], "x int, y int")


def found(spark, cells):
    out = {}
    for r in fronts.rings(mask(spark, cells)).collect():
        out.setdefault(tuple(r.ring), {})[r.position] = (r.x, r.y)
    rings = []
    for corners in out.values():
        assert sorted(corners) == list(range(len(corners)))
        ring = [corners[i] for i in range(len(corners))]
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))
        rings.append(ring)
    return rings


def area(ring):
    return sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_a_ring_around_one_cell(spark):
    assert found(spark, [(3, 4)]) == [[(3, 4), (4, 4), (4, 5), (3, 5)]]


def test_a_hole_and_corners(spark):
    square = [(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)]
    assert sorted(map(area, found(spark, square))) == [-1, 25]
    assert sorted(map(area, found(spark, [(0, 0), (1, 1), (0, 0)]))) == [1, 1]
    facts = {(r.length, r.area) for r in fronts.ring_facts(fronts.rings(mask(spark, square))).collect()}
    assert facts == {(20, 25), (4, -1)}


def test_rings_of_a_random_mask(spark):
    rng = np.random.default_rng(3)
    cells = [(x, y) for x in range(14) for y in range(14) if rng.random() < 0.55]
    rings = found(spark, cells)
    assert sum(map(area, rings)) == len(cells)
    assert sum(map(len, rings)) == sum((x + i, y + j) not in set(cells) for x, y in cells for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))


def test_no_mask(spark):
    assert found(spark, []) == []
    assert fronts.distances(mask(spark, [(0, 0)]), mask(spark, [])).first().d is None


def test_front_distances_are_exact(spark):
    rng = np.random.default_rng(5)
    a, b = (sorted({tuple(map(int, p)) for p in rng.integers(0, 60, (150, 2))}) for _ in range(2))
    got = {(r.x, r.y): r.d for r in fronts.distances(mask(spark, a), mask(spark, b)).collect()}
    assert got == {p: pytest.approx(min(np.hypot(p[0] - q[0], p[1] - q[1]) for q in b)) for p in a}


def test_rate_of_a_disc_that_grows(spark):
    disc = lambda r: [(x, y) for x in range(-40, 41) for y in range(-40, 41) if x * x + y * y <= r * r]
    got = fronts.spread_rate(mask(spark, disc(10)), mask(spark, disc(20)), steps=2, resolution=5.0, minutes=5.0).first()
    assert got.mean_rate == pytest.approx(10 * 5 / 10, rel=0.05)
    same = fronts.front_error(mask(spark, disc(10)), mask(spark, disc(10))).first()
    assert tuple(same) == (0.0, 0.0)
    apart = fronts.rate_error((mask(spark, disc(10)), mask(spark, disc(20))), (mask(spark, disc(10)), mask(spark, disc(15))), 2).first()
    assert apart.relative_error == pytest.approx(1.0, rel=0.05)


def snaps(spark, steps):
    rows = [(s, x, y, 0, 0 if s < x + y else 1 if s < x + y + 3 else 2) for s in range(steps) for x in range(4) for y in range(4)]
    return spark.createDataFrame(rows, "step int, x int, y int, z int, state int")


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_a_stored_history_gives_every_step(spark, tmp_path, level):
    all_steps = snaps(spark, 24)
    store.write_compressed(simulate.compress(all_steps, level), str(tmp_path / "h"), simulate.KEYFRAMES[level])
    voxels, stored = all_steps.where("step = 0"), spark.read.parquet(str(tmp_path / "h"))
    for step in (0, 3, 9, 10, 23):
        got = {tuple(r) for r in simulate.state_at(stored, voxels, step).collect()}
        assert got == {tuple(r) for r in all_steps.where(F.col("step") == step).select("x", "y", "z", "state").collect()}


def test_a_state_reads_one_keyframe(spark, tmp_path):
    sizes = []
    for steps in (12, 48):
        path = str(tmp_path / str(steps))
        store.write_compressed(simulate.compress(snaps(spark, steps), 1), path, 5)
        found = simulate.state_at(spark.read.parquet(path), snaps(spark, 1), 11)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(keyframe" in plan and "(keyframe" in plan and "= 10)]" in plan
        sizes.append(len(spark.read.parquet(path).where("keyframe = 10").inputFiles()))
    assert sizes[0] == sizes[1]


def test_one_wide_box_among_small_ones_ends(spark):
    small = [(x * 50, x * 50 + 40, y * 50, y * 50 + 40) for x in range(12) for y in range(12)]
    wide = [(-2_000_000_000, 2_000_000_000, 120, 130), (7, 7, 5_000, 5_000)]
    out = [tuple(r) for r in tiles.merge_regions(spark.createDataFrame(small + wide, "x_min long, x_max long, y_min long, y_max long")).collect()]
    assert len(out) == 12 * 11 + 2 and (-2_000_000_000, 2_000_000_000, 100, 140) in out and (7, 7, 5_000, 5_000) in out


def test_a_sparse_pyramid_is_read_by_the_finest_known_ancestor(spark):
    cells = spark.createDataFrame([(x, y, x * 100 + y) for x, y in itertools.product(range(16), repeat=2)], "x int, y int, state int")
    levels = raster.pyramid(cells, 5).where("level > 0 OR x < 8").where("level <> 2 OR y < 2")
    boxes = spark.createDataFrame([(0, 15, 0, 3, 0), (0, 3, 4, 15, 1), (2, 9, 2, 9, 2)], "x_min int, x_max int, y_min int, y_max int, level int")
    got = {(r.x, r.y): (r.level, r.state) for r in tiles.multi_resolution(levels, boxes, cells).collect()}
    there = {(r.level, r.x, r.y): r.state for r in levels.collect()}
    for x, y in itertools.product(range(16), repeat=2):
        asks = [level for a, b, c, e, level in ((0, 15, 0, 3, 0), (0, 3, 4, 15, 1), (2, 9, 2, 9, 2)) if a <= x <= b and c <= y <= e]
        known = [(k, there[k, x >> k, y >> k]) for k in range(min(asks, default=4), 5) if (k, x >> k, y >> k) in there]
        assert got[x, y] == known[0]
