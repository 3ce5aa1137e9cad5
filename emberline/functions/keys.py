"""Names of stored tiles and files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tile_key(x: Column, y: Column, step: Column | None = None) -> Column:
    """tile_<x>_<y>, with _step_<n> where a step is given."""
    key = F.concat_ws("_", F.lit("tile"), x.cast("string"), y.cast("string"))
    return key if step is None else F.concat_ws("_", key, F.lit("step"), step.cast("string"))


def parse_key(key: Column) -> Column:
    """Struct of x, y and step (null without one); nulls for names of another form."""
    pattern = r"^tile_(-?\d+)_(-?\d+)(?:_step_(\d+))?$"
    part = lambda i: F.when(F.regexp_extract(key, pattern, i) != "", F.regexp_extract(key, pattern, i)).cast("int")
    return F.struct(part(1).alias("x"), part(2).alias("y"), part(3).alias("step"))
