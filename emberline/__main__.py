"""Command line: density, simulate, benchmark, and config (create, validate, optimise)."""

from __future__ import annotations

import argparse
import json
import logging
import time

from pyspark.sql import SparkSession, functions as F

from emberline import config as C
from emberline.operators import filters, simulate, structure, voxel
from emberline.operators.terrain import uniform_wind
from emberline.sources import las, points as P
from emberline.sources import store

log = logging.getLogger("emberline")


def session() -> SparkSession:
    return SparkSession.builder.appName("emberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read_any(spark, paths: list[str], classes: tuple[int, ...]):
    """Points of LAS files and of Parquet data sets, told apart by their names."""
    files = [p for p in paths if p.lower().endswith((".las", ".laz"))]
    tables = [p for p in paths if p not in files]
    parts = ([las.read_las(spark, files, classes)] if files else []) + ([P.read_points(spark, tables, classes)] if tables else [])
    return parts[0] if len(parts) == 1 else parts[0].select("x", "y", "z", "classification").unionByName(parts[1].select("x", "y", "z", "classification"))


def density(a) -> None:
    """Points to height bins, profile and plant area density by cell."""
    c = C.Config.load(a.config)
    found = read_any(session(), a.points, c.vegetation_classes)
    kept = filters.drop_negative(filters.filter_artefacts(found, a.filter))
    bins = structure.height_bins(kept, c.pad_bin_size)
    store.write_csv(structure.with_support(bins), f"{a.out}/height_bins")
    store.write_csv(structure.profile(bins, c.pad_bin_size, c.extinction_coefficient), f"{a.out}/profile")
    store.write_by(structure.cell_pad(kept, c.pad_bin_size, c.model_resolution, c.extinction_coefficient), f"{a.out}/pad", "bin")


def forest(spark, c: C.Config, side: int, method: str):
    """(state, static) of a generated forest, lit in the middle."""
    voxels = P.generate_fuel(P.grid(spark, side, side, c.num_layers), method, c.num_layers, **({"low": 0.1, "high": 1.0} if method in ("random", "gradient") else {}))
    state = voxel.ignite(voxels, voxel.ignition_points(P.grid(spark, side, side), "center", side, side))
    wind = uniform_wind(P.grid(spark, side, side), c.wind_direction, min(c.wind_speed, 1.0))
    static = voxel.with_connectivity(voxels).join(wind, ["x", "y"]).withColumn("moisture", F.lit(c.fuel_moisture_baseline))
    return state.select("x", "y", "z", "state", "fuel"), static.select("x", "y", "z", "conn_up", "moisture", "dir", "speed", "u", "v")


def run_simulation(a) -> None:
    """A run with its history, statistics, parameters and summary; with --resume it goes on from the last stored step."""
    spark, c = session(), C.Config.load(a.config)
    with store.error_log(spark, a.out):
        state, static = forest(spark, c, a.side, a.fuel)
        first = 0
        if a.resume:
            first, state = store.reopen(spark, f"{a.out}/states")
        history: list = []
        simulate.run(state, static, c, a.side, a.side, a.steps, history=history, first=first)
        snaps = simulate.snapshots(history)
        store.write_history(filters.recorded_steps(snaps, c.save_interval), f"{a.out}/states")
        store.write_by(simulate.compress(snaps, c.storage_optimization_level), f"{a.out}/history", "step")
        stats = simulate.statistics(snaps, c.model_resolution)
        store.write_csv(simulate.wide_statistics(stats, c.num_layers), f"{a.out}/statistics")
        report = simulate.report(history[-1][1], c.model_resolution).first().asDict()
        store.write_json(spark, {"parameters": c.to_dict(), "results": report, "has_wind": True, "has_terrain": False}, f"{a.out}/parameters.json")
        told = {"states": "full states of recorded steps, from which a run can go on", "history": "states and changes by step", "statistics": "counts by step and layer", "parameters.json": "the configuration and a summary"}
        store.write_readme(spark, a.out, told)
    log.info("%s", report)


def benchmark(a) -> None:
    spark, c, rows = session(), C.Config.load(a.config), []
    for side in a.sides:
        state, static = forest(spark, c, side, "random")
        start = time.time()
        simulate.run(state, static, c, side, side, a.steps).count()
        seconds = time.time() - start
        rows.append({"side": side, "layers": c.num_layers, "steps": a.steps, "seconds": seconds, "cells_per_second": side * side * c.num_layers * a.steps / seconds})
    store.write_json(spark, {"runs": rows}, f"{a.out}/benchmark.json")
    print(json.dumps(rows))


def configure(a) -> None:
    c = C.Presets(a.presets).get(a.preset) if a.preset else C.Config.load(a.config)
    if a.action == "optimise":
        c = C.optimise(c, a.width, a.height_m, a.memory)
    broken = C.broken_rules(session(), c)
    print(json.dumps({"valid": not broken, "broken": broken, "config": c.to_dict()}))
    if a.out:
        c.save(a.out)


def main(args: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    parser = argparse.ArgumentParser(prog="emberline")
    parser.add_argument("--config")
    commands = parser.add_subparsers(required=True)
    d = commands.add_parser("density")
    d.add_argument("points", nargs="+"), d.add_argument("--out", required=True), d.add_argument("--filter", default="statistical")
    d.set_defaults(run=density)
    s = commands.add_parser("simulate")
    s.add_argument("--out", required=True), s.add_argument("--side", type=int, default=100), s.add_argument("--steps", type=int, default=20), s.add_argument("--fuel", default="random"), s.add_argument("--resume", action="store_true")
    s.set_defaults(run=run_simulation)
    b = commands.add_parser("benchmark")
    b.add_argument("--out", required=True), b.add_argument("--sides", type=int, nargs="+", default=[100, 200]), b.add_argument("--steps", type=int, default=5)
    b.set_defaults(run=benchmark)
    c = commands.add_parser("config")
    c.add_argument("action", choices=["create", "validate", "optimise"]), c.add_argument("--preset"), c.add_argument("--presets"), c.add_argument("--out")
    c.add_argument("--width", type=float, default=1000.0), c.add_argument("--height-m", type=float, default=1000.0), c.add_argument("--memory", type=int)
    c.set_defaults(run=configure)
    parsed = parser.parse_args(args)
    parsed.run(parsed)


if __name__ == "__main__":
    main()
