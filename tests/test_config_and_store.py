"""Configuration, planning, store, sources and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from emberline import config as C
from emberline.operators import tiles
from emberline.sources import points, store
from emberline.streaming import wind


def test_round_trip_and_unknown_keys(tmp_path):
    path = str(tmp_path / "c.json")
    C.Config(tile_size=64).save(path)
    assert C.Config.load(path).tile_size == 64
    made, unknown = C.Config.from_dict({"MODEL_RESOLUTION": 3.0, "nonsense": 1})
    assert made.model_resolution == 3.0 and unknown == ["nonsense"]


def test_environment_names_the_file(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"num_layers": 5}))
    monkeypatch.setenv(C.ENVIRONMENT, str(path))
    assert C.Config.load().num_layers == 5


@pytest.mark.parametrize(("grid", "layers"), [(g, n) for g in (100, 1000, 5000) for n in (1, 5, 10, 20)])
def test_memory_follows_the_formula(grid, layers):
    plan = C.memory_plan(C.Config(num_layers=layers), grid, grid)
    assert plan["total_mb"] == pytest.approx(grid * grid * layers * 15 / 2**20)
    assert plan["tiling_required"] == (plan["total_mb"] > 4000)


@pytest.mark.parametrize(("w", "h"), [(0, 100), (100, 0), (-10, 100), (100, -10)])
def test_memory_of_empty_grids_is_zero(w, h):
    assert C.memory_plan(C.Config(), w, h)["total_mb"] == 0


def test_optimise_fits_or_tiles():
    base = C.Config(num_layers=12)
    fits = C.optimise(base, 20_000, 20_000, 2000)
    assert fits.model_resolution > base.model_resolution and not C.memory_plan(fits, int(20_000 / fits.model_resolution), int(20_000 / fits.model_resolution))["tiling_required"]
    tiled = C.optimise(base, 200_000, 200_000, 500)
    assert tiled.use_lazy_loading and tiled.tile_size >= 50 and tiled.tile_overlap <= tiled.tile_size * 0.1


def test_presets(tmp_path):
    p = C.Presets()
    assert p.get("windy_conditions").wind_speed == 12.0 and p.get("default", tile_size=10).tile_size == 10
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"default": {"num_layers": 3}}))
    assert C.Presets(str(path)).get("default").num_layers == 3
    assert C.choose_preset(2500 * 2000, 0.8, 8.5) == "large_area"


def test_broken_rules(spark):
    assert C.broken_rules(spark, C.Config()) == []
    assert C.broken_rules(spark, C.Config(tile_size=20)) == ["tile_configuration"]


def test_open_bounds_are_repaired_past_the_bound(spark):
    rules = C.rules_table(spark, [("A", 0.0, 1.0, True, False, False, None, "FIX"), ("B", 0.0, 9.0, True, False, True, None, "FIX")])
    params = spark.createDataFrame([("A", 0.0), ("B", -3.0), ("A", None)], "param string, value double")
    found = {(r.param, r.value): r.fixed_value for r in C.validate(params, rules).collect()}
    assert found[("A", 0.0)] == pytest.approx(1e-10) and found[("B", -3.0)] == 1.0


def test_tile_store(spark, tmp_path):
    s = store.TileStore(spark, str(tmp_path / "tiles"))
    assert s.get(0, 0) is None
    s.put(tiles.tile_of(points.grid(spark, 20, 20), 10).withColumn("v", F.lit(1.0)))
    s.put(tiles.tile_of(points.grid(spark, 10, 10), 10).withColumn("v", F.lit(5.0)))
    assert s.get(0, 0).agg(F.avg("v")).first()[0] == 5.0 and s.get(1, 1).count() == 100
    assert s.info().first()["tiles"] == 4
    s.remove(0, 0)
    assert s.get(0, 0) is None


@pytest.mark.parametrize(("tile", "n"), [((1, 1), 8), ((0, 0), 3)])
def test_neighbours(spark, tile, n):
    found = tiles.tile_neighbours(tiles.tile_grid(spark, 1000, 1000, 200)).where((F.col("tile_x") == tile[0]) & (F.col("tile_y") == tile[1]))
    assert found.count() == n


def test_points_need_valid_classes(spark):
    with pytest.raises(ValueError):
        points.keep_classes(spark.createDataFrame([], "classification int"), (300,))
    with pytest.raises(FileNotFoundError):
        points.read_points(spark, ["a.copc.parquet"])


def test_streamed_wind_equals_the_batch(spark, tmp_path):
    events = spark.range(100).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.lit("wind").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = wind.windows(stream).writeStream.outputMode("complete").format("memory").queryName("wind_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wind_test").exceptAll(wind.windows(events)).isEmpty()
    seen = []
    d = wind.drive(stream, lambda speed, n: seen.append(speed), str(tmp_path / "c"), late="0 seconds")
    d.processAllAvailable()
    d.stop()
    assert seen


def test_merge_needs_several_rounds(spark):
    boxes = [(0, 2, 0, 2), (2, 9, 2, 3), (8, 9, 0, 1), (8, 12, 0, 0), (30, 31, 30, 31)]
    out = tiles.merge_regions(spark.createDataFrame(boxes, "x_min int, x_max int, y_min int, y_max int"))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 12, 0, 3), (30, 31, 30, 31)]


def test_elevation_is_found_in_order(spark, tmp_path):
    from emberline.sources import rasters

    assert rasters.find_elevation(spark, str(tmp_path), "a", ["d1", "d2"]) is None
    for where in ("a/d2", "a/rasters"):
        os.makedirs(tmp_path / where / "dem")
    assert rasters.find_elevation(spark, str(tmp_path), "a", ["d1", "d2"]) == f"{tmp_path}/a/rasters/dem"
