"""Point clouds, tables of the test data as points, and generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.functions.rng import uniform
from emberline.schema import VEGETATION_CLASSES


def read_points(spark: SparkSession, paths: str | list[str], classes: tuple[int, ...] | None = VEGETATION_CLASSES, exclude: str | None = ".copc.") -> DataFrame:
    """Points of one or many Parquet data sets, with the class filter at the scan.

    Paths that contain `exclude` are left out.  Classes must be numbers from 0 to 255.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kept = [p for p in paths if not exclude or exclude not in p]
    if not kept:
        raise FileNotFoundError(f"no point data in {paths}")
    points = spark.read.parquet(*kept)
    return keep_classes(points, classes) if classes is not None else points


def keep_classes(points: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    if not classes or any(not isinstance(c, int) or not 0 <= c <= 255 for c in classes):
        raise ValueError(f"not point classes: {classes}")
    return points.where(F.col("classification").isin(list(classes)))


def with_epsg(points: DataFrame, datasets: DataFrame) -> DataFrame:
    """Points with the EPSG code of their dataset, from a table (dataset, wkt)."""
    code = F.regexp_extract("wkt", r'AUTHORITY\["EPSG","(\d+)"\]\]?\s*$', 1)
    return points.join(datasets.select("dataset", F.when(code != "", code.cast("int")).alias("epsg")), "dataset", "left")


def lineitem_points(spark: SparkSession, sf_dir: str, *further: str) -> DataFrame:
    """The points that the test tables stand for, with further columns of the table."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = (F.col("l_partkey") % 40) * F.lit(5.0) + F.col("l_discount") * F.lit(40.0)
    y = (F.col("l_orderkey") % 40) * F.lit(5.0) + F.col("l_tax") * F.lit(50.0)
    z = F.col("l_quantity") * F.lit(0.6) - F.lit(2.0)
    return t.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col("l_linenumber").alias("classification"), F.col("l_tax").alias("tax"), *further)


def cell(c: str, size: float = 5.0) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("int")


def grid(spark: SparkSession, width: int, height: int, layers: int = 0) -> DataFrame:
    """All cells (x, y) or voxels (x, y, z) of a box, in one range."""
    n = width * height * max(layers, 1)
    out = spark.range(n).select((F.col("id") % width).cast("int").alias("x"), (F.floor(F.col("id") / width) % height).cast("int").alias("y"), F.floor(F.col("id") / (width * height)).cast("int").alias("z"))
    return out if layers else out.drop("z")


def hill(cells: DataFrame, size: int = 40, top: float = 30.0) -> DataFrame:
    """cells with the elevation of an analytic hill on [-3, 3] x [-3, 3]."""
    a, b = (F.lit(-3.0) + F.lit(6.0) * F.col(c) / F.lit(size - 1) for c in "xy")
    return cells.withColumn("elev", F.lit(top) * F.exp(F.lit(-0.5) * (a * a + b * b)))


def random_fuel(voxels: DataFrame, low: float = 0.1, high: float = 10.0, seed: int = 42) -> DataFrame:
    u = uniform(seed, "fuel", F.col("x"), F.col("y"), F.col("z"))
    return voxels.withColumn("fuel", F.lit(low) + F.lit(high - low) * u)


def gradient_fuel(voxels: DataFrame, layers: int, low: float = 0.1, high: float = 10.0, seed: int = 42) -> DataFrame:
    fade = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.8) * F.col("z") / F.lit(layers))
    return random_fuel(voxels, low, high, seed).withColumn("fuel", F.col("fuel") * fade)


def constant_fuel(voxels: DataFrame, value: float = 1.0) -> DataFrame:
    return voxels.withColumn("fuel", F.lit(value))


def layer_fuel(voxels: DataFrame, values: list[float]) -> DataFrame:
    """A value for each layer; the last one repeats."""
    loads = F.array(*[F.lit(float(v)) for v in values])
    return voxels.withColumn("fuel", F.element_at(loads, F.least(F.col("z") + 1, F.lit(len(values))).cast("int")))


def default_fuel(voxels: DataFrame, layers: int, base: float = 1.0) -> DataFrame:
    return voxels.withColumn("fuel", F.lit(base) * (F.lit(1.0) - F.col("z") / F.lit(layers)))


def generate_fuel(voxels: DataFrame, method: str, layers: int, **options) -> DataFrame:
    """By name; an unknown name gives random fuel."""
    makers = {"gradient": lambda: gradient_fuel(voxels, layers, **options), "constant": lambda: constant_fuel(voxels, **options), "layer_specific": lambda: layer_fuel(voxels, **options), "default": lambda: default_fuel(voxels, layers, **options)}
    return makers.get(method, lambda: random_fuel(voxels, **options))()


def benchmark_forest(cells: DataFrame, width: int, height: int, discs: int = 5, seed: int = 42) -> DataFrame:
    """Thin random vegetation with thicker discs, in [0, 1]."""
    out, value = cells, uniform(seed, "base", F.col("x"), F.col("y")) * F.lit(0.5)
    for d in range(discs):
        cx, cy = uniform(seed, "cx", d) * F.lit(width), uniform(seed, "cy", d) * F.lit(height)
        r = F.floor(F.lit(20.0) + uniform(seed, "r", d) * F.lit(80.0))
        dx, dy = F.col("x") - F.floor(cx), F.col("y") - F.floor(cy)
        value = value + F.when(dx * dx + dy * dy <= r * r, uniform(seed, "disc", d, F.col("x"), F.col("y")) * F.lit(0.5)).otherwise(F.lit(0.0))
    return out.withColumn("vegetation", F.least(F.lit(1.0), value))


def disc_seed(cells: DataFrame, width: int, height: int) -> DataFrame:
    """A burning disc in the middle of full, dry vegetation."""
    r = min(10, width // 20)
    dx, dy = F.col("x") - F.lit(width // 2), F.col("y") - F.lit(height // 2)
    return cells.select("*", F.when(dx * dx + dy * dy < r * r, 1).otherwise(0).alias("state"), F.lit(1.0).alias("vegetation"), F.lit(0.0).alias("moisture"))
