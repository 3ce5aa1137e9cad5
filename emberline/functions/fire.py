"""Probabilities and factors of fire spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from emberline.functions.rng import normal, uniform

# The eight neighbours (dx, dy).
NEIGHBOURS = [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, -1), (-1, 1), (1, 1)]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column, steepness: float = 1.5, threshold: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (x - F.lit(threshold))))


def wind_effect(u: Column, v: Column, dx: Column, dy: Column, most: float = 1.0) -> Column:
    """Along-wind part of a move; the y axis of the grid runs against the wind's."""
    length = F.sqrt((dx * dx + dy * dy).cast("double"))
    return F.greatest(F.lit(0.0), (u * dx - v * dy) / length) * F.lit(most)


def angle_between(degrees_a: Column, degrees_b: Column) -> Column:
    return F.abs(F.pmod(degrees_a - degrees_b + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))


def wind_factor(dx: Column, dy: Column, direction: Column, strength: Column) -> Column:
    a = angle_between(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), direction)
    with_wind = F.lit(1.0) + strength * (F.lit(1.0) - a / 90)
    against = F.greatest(F.lit(0.1), F.lit(1.0) - strength * (a - 90) / 90)
    return F.when((strength == 0) | ((dx == 0) & (dy == 0)), 1.0).when(a <= 90, with_wind).otherwise(against)


def terrain_factor(dx: Column, dy: Column, aspect: Column, slope: Column, influence: float) -> Column:
    a = angle_between(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), aspect)
    up = F.lit(1.0) + F.lit(influence) * slope * (F.lit(1.0) - a / 90)
    down = F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(influence) * slope * (a - 90) / 90 * F.lit(0.5))
    return F.when(slope.isNull() | ((dx == 0) & (dy == 0)), 1.0).when(a <= 90, up).otherwise(down)


def horizontal_probability(burning: Column, fuel: Column, wind: Column, moisture: Column, diagonal: Column, factor: float = 0.707, steepness: float = 1.5, threshold: float = 1.0) -> Column:
    p = sigmoid(burning, steepness, threshold) * fuel * (F.lit(1.0) + wind) * (F.lit(1.0) - moisture)
    return clamp(p * F.when(diagonal, F.lit(factor)).otherwise(F.lit(1.0)))


def upward_probability(conn: Column, moisture: Column, fuel_above: Column, z: Column, canopy: int, crown: float) -> Column:
    return clamp(conn * (F.lit(1.0) - moisture) * fuel_above * F.when(z >= canopy, F.lit(crown)).otherwise(F.lit(1.0)))


def downward_probability(fuel_below: Column, base: float = 0.15) -> Column:
    return clamp(F.lit(base) * fuel_below)


def connectivity(lower: Column, upper: Column, height: float = 2.0) -> Column:
    """Vertical connection of two fuel values in [0, 1]."""
    a, b = lower * 10, upper * 10
    even = F.lit(1.0) - clamp(F.abs(a - b) / F.greatest(a + b, F.lit(1e-6)))
    light = F.lit(1.0) - F.abs(F.exp(F.lit(-0.5 * height) * a) - F.exp(F.lit(-0.5 * height) * b))
    return F.lit(0.1) + F.lit(0.8) * (F.lit(0.4) * F.least(a, b) / 10 + F.lit(0.4) * even + F.lit(0.2) * light)


def consumption_rate(z: Column, layers: int, base: float = 0.2) -> Column:
    return F.lit(base) * (F.lit(1.0) - F.lit(0.5) * z / F.lit(layers))


def ember_draw(direction: Column, speed: Column, x: Column, y: Column, z: Column, base: int, drop: int, y_sign: int, *key) -> Column:
    """Struct of angle, distance, tx, ty, tz, vertical of one ember."""
    angle = direction + F.lit(math.pi / 4) * F.greatest(F.lit(0.0), F.lit(1.0) - speed) * normal(*key, "angle")
    distance = F.greatest(F.lit(1), F.least(F.lit(2 * base), (F.lit(float(base)) * (F.lit(1.0) + speed * F.cos(angle - direction))).cast("int") + 1))
    deepest = F.least(F.lit(drop), z)
    fall = F.when(deepest > 0, -(F.lit(1) + F.floor(uniform(*key, "fall") * deepest).cast("int"))).otherwise(F.lit(0))
    tx = (x + distance * F.cos(angle)).cast("int")
    ty = (y + F.lit(y_sign) * distance * F.sin(angle)).cast("int")
    return F.struct(angle.alias("angle"), distance.alias("distance"), tx.alias("tx"), ty.alias("ty"), (z + fall).cast("int").alias("tz"), fall.cast("int").alias("vertical"))


def ember_probability(distance: Column, vertical: Column, fuel: Column, base: int = 5, ignition: float = 0.6, least: float = 0.3, penalty: float = 0.2, multiplier: float = 0.5) -> Column:
    """Falling makes ignition likelier here: vertical is negative and enters with a minus sign."""
    near = F.greatest(F.lit(least), F.lit(1.0) - distance / F.lit(float(base)))
    deep = F.greatest(F.lit(least), F.lit(1.0) - vertical * F.lit(penalty))
    return clamp(F.lit(ignition) * near * deep * (F.lit(1.0) + fuel * F.lit(multiplier)))


def burn_pattern(percent: Column) -> Column:
    return F.when(percent <= 0, "none").when(percent < 10, "limited").when(percent < 30, "moderate").when(percent < 60, "extensive").otherwise("catastrophic")


def met_degrees_to_radians(degrees: Column) -> Column:
    """Compass bearing (0 north, clockwise) to mathematical angle (0 east)."""
    return F.radians(F.pmod(F.lit(90.0) - degrees, F.lit(360.0)))


def duration(step: Column, minutes: int = 5) -> Column:
    total = step * minutes
    return F.format_string("%dh %dm", F.floor(total / 60).cast("long"), (total % 60).cast("long"))


def resolution_level(slope: Column, ruggedness: Column) -> Column:
    return F.when((slope > 35) | (ruggedness > 80), 0).when((slope > 20) | (ruggedness > 50), 1).when((slope > 10) | (ruggedness > 20), 2).otherwise(3)


def coarser_resolution(resolution: Column, cells: Column, limit: Column) -> Column:
    """Resolution at which the longer side has `limit` cells at most, rounded up to halves."""
    return F.when(cells > limit, F.ceil(resolution * cells / limit * 2) / 2).otherwise(resolution)
