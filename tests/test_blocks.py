"""Blocks of many steps against the same steps as joins."""

import pytest
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.functions.rng import uniform
from emberline.operators import blocks, simulate, spread
from emberline.scratch import stage
from emberline.sources import points as P


def forest(spark, width, height, layers):
    voxels = P.grid(spark, width, height, layers).where("NOT (x = 4 AND y = 5)")
    keys = (F.col("x"), F.col("y"), F.col("z"))
    fuel = F.when(F.col("x") % 7 == 3, 0.0).otherwise(uniform(1, "f", *keys))
    lit = (F.abs(F.col("x") - width // 2) <= 1) & (F.abs(F.col("y") - height // 2) <= 1) | (F.col("x") == 0)
    state = voxels.select("x", "y", "z", F.when(lit, 1).when(F.col("y") == 2, 2).otherwise(0).alias("state"), fuel.alias("fuel"))
    static = voxels.where("NOT (x = 9 AND y = 9)").select("x", "y", "z", F.when(F.col("z") < layers - 1, uniform(1, "c", *keys)).alias("conn_up"), (uniform(1, "m", *keys) * 0.5).alias("moisture"), (uniform(1, "d", *keys) * 6.0).alias("dir"), uniform(1, "s", *keys).alias("speed"))
    static = static.withColumns({"u": F.col("speed") * F.cos("dir"), "v": F.col("speed") * F.sin("dir")})
    return stage(state, "state"), stage(static, "static")


def by_joins(state, static, c, width, height, steps, open_edge):
    for step in range(steps):
        level = stage(spread.horizontal(state, static, step, c, width, height, open_edge), "level")
        state = stage(spread.vertical(level, static, step, c, width, height, open_edge), "step")
    return state


def rows(df):
    return sorted((r.x, r.y, r.z, r.state, round(r.fuel, 9)) for r in df.collect())


@pytest.mark.parametrize(("side", "embers", "open_edge"), [(512, 0.3, False), (16, 0.3, True), (12, 0.0, False)])
def test_blocks_equal_joins(spark, monkeypatch, side, embers, open_edge):
    monkeypatch.setattr(blocks, "block_side", lambda layers: side)
    monkeypatch.setattr(simulate, "ROUND", 3)
    c = Config(num_layers=3, canopy_start_layer=1, ember_probability=embers, ember_distance=3)
    state, static = forest(spark, 40, 30, 3)
    expected = by_joins(state, static, c, 40, 30, 4, open_edge)
    history: list = []
    found = simulate.run(state, static, c, 40, 30, 4, open_edge, history=history)
    assert rows(found) == rows(expected) and [s for s, _ in history] == [0, 1, 2, 3, 4]
    assert rows(history[2][1]) == rows(by_joins(state, static, c, 40, 30, 2, open_edge))
    assert rows(simulate.run(state, static, c, 40, 30, 4, open_edge)) == rows(expected)


def test_a_run_goes_on_from_a_stored_step(spark, tmp_path):
    from emberline.sources import store

    c = Config(num_layers=2, canopy_start_layer=1, ember_probability=0.2)
    state, static = forest(spark, 24, 24, 2)
    history: list = []
    whole = simulate.run(state, static, c, 24, 24, 5, history=history)
    store.write_history(simulate.snapshots(history[:4]), str(tmp_path / "h"))
    step, again = store.reopen(spark, str(tmp_path / "h"))
    assert step == 3 and rows(simulate.run(again, static, c, 24, 24, 2, first=step)) == rows(whole)
    assert store.reopen(spark, str(tmp_path / "h"), 1)[0] == 1
    with pytest.raises(FileNotFoundError):
        store.reopen(spark, str(tmp_path / "h"), 9)


def test_idle_blocks_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(blocks, "block_side", lambda layers: 10)
    c = Config(num_layers=1, ember_probability=0.0)
    voxels = P.grid(spark, 100, 100, 1)
    state = voxels.select("x", "y", "z", F.when((F.col("x") == 5) & (F.col("y") == 5), 1).otherwise(0).alias("state"), F.lit(1.0).alias("fuel"))
    static = voxels.select("x", "y", "z", F.lit(0.5).alias("conn_up"), F.lit(0.1).alias("moisture"), *[F.lit(0.0).alias(n) for n in ("u", "v", "dir", "speed")])
    rules = blocks.rules(c, 100, 100, 1)
    start = stage(blocks.to_blocks(state, static, rules, 10), "b")
    done = blocks.round_of(start, rules, 10, 0, 2, False)
    assert done.count() == 100
    moved = done.alias("a").join(start.alias("b"), ["bx", "by"]).where("a.state <> b.state").select("bx", "by").collect()
    assert {(r.bx, r.by) for r in moved} <= {(0, 0)}


def test_empty_grid(spark):
    state = spark.createDataFrame([], "x int, y int, z int, state int, fuel double")
    static = spark.createDataFrame([], "x int, y int, z int, conn_up double, moisture double, u double, v double, dir double, speed double")
    assert simulate.run(state, static, Config(), 5, 5, 3).collect() == []
