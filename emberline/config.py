"""Configuration: fields, presets, validation, memory planning and optimisation."""

from __future__ import annotations

import dataclasses
import json
import math
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENVIRONMENT = "FOREST_MODEL_CONFIG"


@dataclass(frozen=True)
class Config:
    """Parameters of a scenario.

    The last block holds values that the published description leaves open; they are
    assumptions of this engine.
    """

    model_resolution: float = 5.0
    num_layers: int = 8
    layer_height: float = 2.0
    spread_probability: float = 0.3
    vertical_spread: float = 0.2
    downward_spread: float = 0.15
    diagonal_factor: float = 0.707
    ember_probability: float = 0.02
    ember_distance: int = 5
    ember_rise: int = 3
    ember_ignition: float = 0.6
    embers_per_cell: int = 3
    ember_vertical_penalty: float = 0.2
    ember_min_probability: float = 0.3
    ember_fuel_multiplier: float = 0.5
    wind_speed: float = 0.5
    wind_direction: float = 0.0
    wind_influence: float = 0.5
    slope_influence: float = 0.3
    terrain_effect: float = 0.5
    barranco_threshold: float = 5.0
    barranco_amplification: float = 1.5
    fuel_moisture_baseline: float = 0.3
    moisture_influence: float = 0.6
    min_fuel_value: float = 0.1
    max_fuel_value: float = 10.0
    fuel_consumption_rate: float = 0.2
    sigmoid_steepness: float = 1.5
    sigmoid_threshold: float = 1.0
    spread_threshold: float = 0.01
    tile_size: int = 200
    tile_overlap: int = 20
    memory_limit_mb: int = 4000
    bytes_per_cell: int = 15
    storage_optimization_level: int = 1
    history_save_interval: int = 10
    use_lazy_loading: bool = False
    max_steps: int = 200
    save_interval: int = 10
    random_seed: int = 42
    stop_when_fire_extinguished: bool = True
    output_dir: str = "results"
    viz_frame_interval_ms: int = 200
    viz_elevation_factor: float = 1.5
    extinction_coefficient: float = 0.6
    pad_bin_size: float = 2.0
    vegetation_classes: tuple[int, ...] = (3, 4, 5)
    # assumptions
    wind_effect_max: float = 1.0
    canopy_start_layer: int = 4
    crown_multiplier: float = 1.5
    default_fuel_load: float = 1.0

    def with_changes(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> tuple[Config, list[str]]:
        """The configuration and the keys that it does not know, which are ignored."""
        names = {f.name for f in dataclasses.fields(cls)}
        known = {ALIASES.get(k, k.lower()): v for k, v in values.items()}
        if "vegetation_classes" in known:
            known["vegetation_classes"] = tuple(known["vegetation_classes"])
        return cls(**{k: v for k, v in known.items() if k in names}), sorted(k for k in values if ALIASES.get(k, k.lower()) not in names)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From a JSON file, the file that the environment names, or the defaults."""
        path = path or os.environ.get(ENVIRONMENT)
        return cls.from_dict(json.loads(Path(path).read_text()))[0] if path else cls()

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2))

    def subset(self, part: str) -> dict:
        """The fields of one part of the model."""
        return {k: getattr(self, k) for k in SUBSETS[part]}


# Upper-case parameter names of configuration files.
ALIASES = {
    "MODEL_RESOLUTION": "model_resolution", "DEFAULT_NUM_LAYERS": "num_layers", "DEFAULT_TILE_SIZE": "tile_size", "DEFAULT_TILE_OVERLAP": "tile_overlap",
    "MAX_STEPS": "max_steps", "MEMORY_LIMIT_MB": "memory_limit_mb", "HORIZONTAL_SPREAD_PROBABILITY": "spread_probability", "VERTICAL_SPREAD_PROBABILITY": "vertical_spread",
    "WIND_INFLUENCE": "wind_influence", "SLOPE_INFLUENCE": "slope_influence", "STORAGE_OPTIMIZATION_LEVEL": "storage_optimization_level",
}

SUBSETS = {
    "tiles": ("tile_size", "tile_overlap", "memory_limit_mb", "bytes_per_cell"),
    "spread": ("spread_probability", "vertical_spread", "downward_spread", "diagonal_factor", "sigmoid_steepness", "sigmoid_threshold", "spread_threshold"),
    "embers": ("ember_probability", "ember_distance", "ember_rise", "ember_ignition", "embers_per_cell"),
    "wind": ("wind_speed", "wind_direction", "wind_influence", "terrain_effect", "barranco_threshold", "barranco_amplification"),
    "density": ("extinction_coefficient", "pad_bin_size", "vegetation_classes"),
}

# The presets.
PRESETS: dict[str, dict] = {
    "default": {"model_resolution": 5.0, "num_layers": 8, "spread_probability": 0.3, "vertical_spread": 0.2, "wind_speed": 5.0, "wind_direction": 0.0, "tile_size": 200, "max_steps": 200},
    "high_resolution": {"model_resolution": 2.0, "num_layers": 12, "spread_probability": 0.28, "vertical_spread": 0.22, "wind_speed": 5.0, "wind_direction": 0.0, "tile_size": 150, "max_steps": 300},
    "large_area": {"model_resolution": 10.0, "num_layers": 6, "spread_probability": 0.35, "vertical_spread": 0.18, "wind_speed": 5.0, "wind_direction": 0.0, "tile_size": 300, "max_steps": 150},
    "windy_conditions": {"model_resolution": 5.0, "num_layers": 8, "spread_probability": 0.4, "vertical_spread": 0.25, "ember_probability": 0.08, "ember_distance": 8, "wind_speed": 12.0, "wind_direction": 90.0, "tile_size": 200, "max_steps": 250},
}


class Presets:
    """Named partial configurations; those of a file override the built-in ones."""

    def __init__(self, path: str | None = None):
        self.values = {k: dict(v) for k, v in PRESETS.items()}
        if path and Path(path).exists():
            self.values |= json.loads(Path(path).read_text())

    def names(self) -> list[str]:
        return sorted(self.values)

    def get(self, name: str, **overrides) -> Config:
        return Config.from_dict(self.values[name] | overrides)[0]

    def add(self, name: str, values: dict) -> None:
        self.values[name] = dict(values)

    def remove(self, name: str) -> bool:
        return self.values.pop(name, None) is not None

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.values, indent=2))


def choose_preset(area_m2: float, density: float, wind: float) -> str:
    """Large areas first, then strong wind, then dense vegetation."""
    if area_m2 > 4_000_000:
        return "large_area"
    if wind > 7:
        return "windy_conditions"
    return "high_resolution" if density > 0.7 else "default"


def preset_choice(area_m2: Column, density: Column, wind: Column) -> Column:
    """choose_preset for each row of a table of study areas."""
    return F.when(area_m2 > 4_000_000, "large_area").when(wind > 7, "windy_conditions").when(density > 0.7, "high_resolution").otherwise("default")


def field_table(spark: SparkSession, configs: dict[str, Config], part: str | None = None) -> DataFrame:
    """(config, field, value) of the fields of configurations, or of one part of them; values as JSON."""
    rows = [(name, k, json.dumps(v)) for name, c in sorted(configs.items()) for k, v in sorted((c.subset(part) if part else c.to_dict()).items())]
    return spark.createDataFrame(rows, "config string, field string, value string")


def preset_table(spark: SparkSession, presets: Presets | None = None) -> DataFrame:
    """(preset, param, value) rows."""
    values = (presets or Presets()).values
    return spark.createDataFrame([(p, k, str(v)) for p, d in sorted(values.items()) for k, v in sorted(d.items())], "preset string, param string, value string")


def override(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Parameters (param, value) with those of the right side winning."""
    right = changes.select("param", F.col("value").alias("changed"))
    return base.join(right, "param", "full_outer").select("param", F.coalesce("changed", "value").alias("value"))


# Cross-field rules as SQL conditions that hold for a valid configuration.
FIELD_RULES: dict[str, str] = {
    "model_resolution": "model_resolution > 0", "num_layers": "num_layers > 0", "layer_height": "layer_height > 0",
    "spread_probability": "spread_probability BETWEEN 0 AND 1", "vertical_spread": "vertical_spread BETWEEN 0 AND 1", "downward_spread": "downward_spread BETWEEN 0 AND 1",
    "diagonal_factor": "diagonal_factor >= 0", "ember_probability": "ember_probability BETWEEN 0 AND 1", "ember_ignition": "ember_ignition BETWEEN 0 AND 1",
    "ember_distance": "ember_distance >= 0", "ember_rise": "ember_rise >= 0", "wind_speed": "wind_speed >= 0", "wind_influence": "wind_influence BETWEEN 0 AND 1",
    "slope_influence": "slope_influence BETWEEN 0 AND 1", "fuel_moisture_baseline": "fuel_moisture_baseline BETWEEN 0 AND 1", "moisture_influence": "moisture_influence BETWEEN 0 AND 1",
    "min_fuel_value": "min_fuel_value >= 0", "max_fuel_value": "max_fuel_value > min_fuel_value", "fuel_consumption_rate": "fuel_consumption_rate > 0 AND fuel_consumption_rate <= 1",
    "tile_size": "tile_size > 0", "tile_overlap": "tile_overlap >= 0", "tile_configuration": "tile_size > 2 * tile_overlap", "memory_limit_mb": "memory_limit_mb > 0",
    "bytes_per_cell": "bytes_per_cell > 0", "max_steps": "max_steps > 0", "save_interval": "save_interval > 0", "viz_frame_interval_ms": "viz_frame_interval_ms > 0",
    "viz_elevation_factor": "viz_elevation_factor > 0", "extinction_coefficient": "extinction_coefficient > 0", "pad_bin_size": "pad_bin_size > 0",
}


def field_checks(configs: DataFrame) -> DataFrame:
    """(config, rule, ok) of each rule on each row of a table with one column for each field."""
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(v).alias("ok")) for k, v in FIELD_RULES.items()])
    return configs.select("config", F.inline(rules))


def broken_rules(spark: SparkSession, config: Config) -> list[str]:
    row = {k: v for k, v in config.to_dict().items() if not isinstance(v, tuple)}
    table = spark.createDataFrame([row | {"config": "c"}])
    return [r["rule"] for r in field_checks(table).where(~F.col("ok")).collect()]


# Default rules (param, lower, upper, lower exclusive, upper exclusive, whole number, choices, level).
DEFAULT_RULES = [
    ("MODEL_RESOLUTION", 0.1, 100.0, False, False, False, None, "ERROR"), ("DEFAULT_NUM_LAYERS", 1.0, 100.0, False, False, True, None, "ERROR"),
    ("DEFAULT_TILE_SIZE", 16.0, 1024.0, False, False, True, None, "WARNING"), ("DEFAULT_TILE_OVERLAP", 0.0, 100.0, False, False, True, None, "WARNING"),
    ("MAX_STEPS", 1.0, 10000.0, False, False, True, None, "WARNING"), ("MEMORY_LIMIT_MB", 100.0, 1000000.0, False, False, True, None, "FIX"),
    ("HORIZONTAL_SPREAD_PROBABILITY", 0.0, 1.0, False, False, False, None, "FIX"), ("VERTICAL_SPREAD_PROBABILITY", 0.0, 1.0, False, False, False, None, "FIX"),
    ("WIND_INFLUENCE", 0.0, 100.0, False, False, False, None, "WARNING"), ("SLOPE_INFLUENCE", 0.0, 100.0, False, False, False, None, "WARNING"),
    ("STORAGE_OPTIMIZATION_LEVEL", None, None, False, False, True, [0.0, 1.0, 2.0, 3.0], "FIX"), ("DEFAULT_MEMORY_OPTIMIZATION_LEVEL", 0.0, 3.0, False, False, True, None, "FIX"),
]
RULE = "param string, lower double, upper double, lower_open boolean, upper_open boolean, whole boolean, choices array<double>, level string"


def rules_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(rules if rules is not None else DEFAULT_RULES, RULE)


def validate(params: DataFrame, rules: DataFrame) -> DataFrame:
    """(param, value, is_valid, message, fixed_value, level) of each parameter with a rule.

    The repaired value is the nearest bound, past an open bound by one (whole numbers)
    or 1e-10, and for choices the smallest one.  Only level FIX repairs; a null value is
    not valid.  Own rules are further rows of the rules table.
    """
    v = F.col("value")
    nudge = F.when(F.col("whole"), 1.0).otherwise(1e-10)
    low = F.col("lower") + F.when(F.col("lower_open"), nudge).otherwise(0.0)
    high = F.col("upper") - F.when(F.col("upper_open"), nudge).otherwise(0.0)
    under = F.when(F.col("lower_open"), v <= F.col("lower")).otherwise(v < F.col("lower"))
    over = F.when(F.col("upper_open"), v >= F.col("upper")).otherwise(v > F.col("upper"))
    outside = F.col("choices").isNotNull() & ~F.coalesce(F.array_contains("choices", v), F.lit(False))
    valid = v.isNotNull() & ~F.coalesce(under, F.lit(False)) & ~F.coalesce(over, F.lit(False)) & ~outside
    repaired = F.when(outside, F.array_min("choices")).when(under, low).when(over, high).otherwise(v)
    why = F.when(valid, "ok").when(v.isNull(), "missing").when(outside, "not an allowed choice").when(under, "below the lower bound").otherwise("above the upper bound")
    joined = params.join(F.broadcast(rules), "param")  # one row for each rule
    return joined.select("param", "value", valid.alias("is_valid"), why.alias("message"), F.when(~valid & (F.col("level") == "FIX"), repaired).alias("fixed_value"), "level")


def memory_parts(grid: int, layers: int) -> dict[str, float]:
    """Megabytes by component of an untiled model."""
    cells, flat, mb = grid * grid * layers, grid * grid, 1024 * 1024
    parts = {"fuel_load": 4 * cells, "state": cells, "vertical_connectivity": 4 * cells, "wind_direction": 4 * flat, "wind_strength": 4 * flat, "terrain_height": 4 * flat, "moisture": 4 * flat, "history": max(400 * layers, 0.01 * cells), "other": cells}
    out = {k: v / mb for k, v in parts.items()}
    return out | {"total": sum(out.values())}


def memory_plan(config: Config, width: int, height: int) -> dict:
    """Cells, megabytes and, where they exceed the limit, the tiling that fits."""
    width, height = max(width, 0), max(height, 0)
    cells = width * height * config.num_layers
    out = {"width_cells": width, "height_cells": height, "total_cells": cells, "total_mb": cells * config.bytes_per_cell / 1024 / 1024, "tiling_required": False}
    if out["total_mb"] > config.memory_limit_mb:
        fits = int(math.sqrt(config.memory_limit_mb * 1024 * 1024 / config.bytes_per_cell / config.num_layers))
        side = min(fits, config.tile_size)
        step = max(1, side - 2 * config.tile_overlap)
        across, down = -(-width // step), -(-height // step)
        out |= {"tiling_required": True, "tile_side": side, "effective_side": step, "tiles_x": across, "tiles_y": down, "total_tiles": across * down}
    return out


def optimise(config: Config, width_m: float, height_m: float, limit_mb: int | None = None) -> Config:
    """Reduce history, resolution and layers, in this order, and tile at last, until the plan fits."""
    c = config.with_changes(memory_limit_mb=limit_mb or config.memory_limit_mb)
    over = lambda c: memory_plan(c, int(width_m / c.model_resolution), int(height_m / c.model_resolution))["total_mb"] > c.memory_limit_mb
    if not over(c):
        return c
    if c.storage_optimization_level < 2:
        c = c.with_changes(storage_optimization_level=2, history_save_interval=20)
    coarsest = 2 * c.model_resolution
    while over(c) and c.model_resolution < coarsest:
        c = c.with_changes(model_resolution=c.model_resolution + 0.5)
    while over(c) and c.num_layers > 5:
        c = c.with_changes(num_layers=c.num_layers - 1)
    if over(c):
        plan = memory_plan(c, int(width_m / c.model_resolution), int(height_m / c.model_resolution))
        side = max(plan["tile_side"], 50)
        c = c.with_changes(tile_size=side, tile_overlap=min(int(side * 0.1), c.tile_overlap), use_lazy_loading=True)
    return c
