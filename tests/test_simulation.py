"""Properties of the simulation, and a plain automaton as an independent check."""

import pytest
from pyspark.sql import functions as F

from emberline.config import Config
from emberline.operators import simulate, spread
from emberline.sources import points as P

SURE = Config(num_layers=1, sigmoid_steepness=1e-9, sigmoid_threshold=-1e12, fuel_consumption_rate=1.0, ember_probability=0.0, diagonal_factor=1.0, downward_spread=0.0)


def table(spark, n, layers, lit):
    state = P.grid(spark, n, n, layers).withColumn("fuel", F.lit(1.0)).withColumn("state", F.when(F.concat_ws(",", "x", "y", "z").isin([",".join(map(str, p)) for p in lit]), 1).otherwise(0))
    static = state.select("x", "y", "z", F.lit(0.5).alias("conn_up"), F.lit(0.0).alias("moisture"), F.lit(0.0).alias("dir"), F.lit(0.0).alias("speed"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    return state.select("x", "y", "z", "state", "fuel"), static


def plain(n, lit, steps, open_edge):
    """All neighbours of a burning cell ignite; a cell burns one step and is out in the next."""
    state, fuel = {(x, y): 0 for x in range(n) for y in range(n)}, {(x, y): 1.5 for x in range(n) for y in range(n)}
    state.update(dict.fromkeys(lit, 1))
    for _ in range(steps):
        new = dict(state)
        for (x, y), s in state.items():
            if s != 1 or not (open_edge or (0 < x < n - 1 and 0 < y < n - 1)):
                continue
            fuel[x, y] -= 1.0
            if fuel[x, y] <= 0:
                new[x, y] = 2
                continue
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if state.get((x + i, y + j)) == 0:
                        new[x + i, y + j] = 1
        state = new
    return state


@pytest.mark.parametrize("open_edge", [False, True])
def test_sure_spread_equals_a_plain_automaton(spark, open_edge):
    state, static = table(spark, 11, 1, [(5, 5, 0)])
    out = simulate.run(state.withColumn("fuel", F.lit(1.5)), static, SURE, 11, 11, 5, open_edge)
    found = {(r.x, r.y): r.state for r in out.collect()}
    assert found == plain(11, [(5, 5)], 5, open_edge)


def test_edge_cells_never_act(spark):
    state, static = table(spark, 8, 1, [(0, 0, 0)])
    out = simulate.run(state, static, SURE, 8, 8, 3)
    assert [(r.x, r.y, r.state) for r in out.where("state > 0").collect()] == [(0, 0, 1)]


@pytest.fixture(scope="module")
def history(spark):
    c = Config(num_layers=3, canopy_start_layer=1, ember_probability=0.3)
    state, static = table(spark, 12, 3, [(5, 5, 0), (6, 6, 1)])
    steps: list = []
    simulate.run(state, static, c, 12, 12, 6, history=steps)
    return simulate.snapshots(steps).cache()


def test_states_only_grow(history):
    worse = simulate.changes(history).where("state <= before")
    assert worse.isEmpty()


def test_counts_add_up(history):
    stats = simulate.statistics(history)
    assert stats.where("z IS NULL AND unburned + burning + burned <> 432").isEmpty()
    assert stats.where("z IS NOT NULL AND unburned + burning + burned <> 144").isEmpty()


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_any_state_comes_back_from_history(spark, history, level):
    packed = simulate.compress(history, level)
    for step in (0, 3, 6):
        found = simulate.state_at(packed, P.grid(spark, 12, 12, 3), step)
        expected = history.where(F.col("step") == step).select("x", "y", "z", "state")
        assert found.exceptAll(expected).isEmpty()


def test_result_does_not_depend_on_partitions(spark, history):
    c = Config(num_layers=3, canopy_start_layer=1, ember_probability=0.3)
    state, static = table(spark, 12, 3, [(5, 5, 0), (6, 6, 1)])
    again = simulate.run(state.repartition(7, "y"), static.repartition(3), c, 12, 12, 6)
    last = history.where("step = 6").select("x", "y", "z", "state", "fuel")
    assert again.exceptAll(last).isEmpty() and again.count() == last.count()


def test_simple_step_keeps_the_rim(spark):
    cells = P.disc_seed(P.grid(spark, 40, 40), 40, 40).drop("moisture")
    out = spread.simple_step(cells, 0, 40, 40)
    assert out.count() == 1600
    assert out.where("(x = 0 OR y = 0) AND state > 0").isEmpty()
