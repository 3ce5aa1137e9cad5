"""Rasters as long tables, and tables in text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_raster(spark: SparkSession, path: str, nodata: float = -9999.0, fill: float | None = 0.0) -> DataFrame:
    """(row, col, value) with nodata replaced by fill, or by null."""
    raster = spark.read.parquet(path)
    return replace_nodata(raster, nodata, fill)


def replace_nodata(raster: DataFrame, nodata: float = -9999.0, fill: float | None = 0.0) -> DataFrame:
    return raster.withColumn("value", F.when(F.col("value") == F.lit(nodata), F.lit(fill)).otherwise(F.col("value")))


def fill_with_least(raster: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Elevation models: nodata becomes the smallest valid value."""
    least = raster.where(F.col("value") != nodata).agg(F.min("value").alias("least"))  # one row
    return raster.join(F.broadcast(least)).withColumn("value", F.when(F.col("value") == nodata, F.col("least")).otherwise(F.col("value"))).drop("least")


def raster_files(files: DataFrame, layer_height: float, layers: int) -> DataFrame:
    """(path, layer): the layer a file's name stands for; of equal layers the last path wins.

    `layer_<n>` is layer n - 1, `bin_<h>m` the layer at height h, any other first number n
    is layer n - 1.  Layers outside the model are left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    by_layer, by_bin, number = (F.regexp_extract(name, p, 1) for p in (r"layer_(\d+)", r"bin_(\d+)m", r"(\d+)"))
    layer = F.when(by_layer != "", by_layer.cast("int") - 1).when(by_bin != "", F.floor(by_bin.cast("double") / layer_height).cast("int")).when(number != "", number.cast("int") - 1)
    found = files.select("path", layer.alias("layer")).where(F.col("layer").between(0, layers - 1))
    return found.groupBy("layer").agg(F.max("path").alias("path")).select("path", "layer")


def find_rasters(spark: SparkSession, folder: str, layer_height: float = 2.0, layers: int = 8) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(folder).select("path")
    return raster_files(files, layer_height, layers)


def parse_profile(lines: DataFrame) -> DataFrame:
    """(height, nrd) from text lines of a profile file; notes, headers and broken rows are skipped."""
    part = F.split("value", ",")
    height, nrd = (F.expr(f"try_cast(trim(split(value, ',')[{i}]) AS DOUBLE)") for i in (0, 1))
    return lines.where(F.size(part) >= 2).select(height.alias("height"), nrd.alias("nrd")).where("height IS NOT NULL AND nrd IS NOT NULL")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return parse_profile(spark.read.text(path))


def read_moisture(bands: DataFrame, cells: DataFrame, layers: int, default: float = 0.3, low: float = 0.1, high: float = 0.9, nodata: float = -9999.0) -> DataFrame:
    """(x, y, z, moisture): bands (band, x, y, value) scaled to [low, high] on the layers.

    Band z belongs to layer z; a single band serves all layers; layers and cells without a
    value, nodata and constant bands keep the default.
    """
    raw = F.when(F.col("value") == nodata, F.lit(default)).otherwise(F.col("value"))
    w = Window.partitionBy("band")
    least, most = F.min("raw").over(w), F.max("raw").over(w)
    scaled = bands.withColumn("raw", raw).withColumn("moisture", F.when(most > least, F.lit(low) + (F.col("raw") - least) / (most - least) * F.lit(high - low)).otherwise(F.lit(default)))
    single = bands.agg(F.max("band").alias("top"))  # one row
    spread = scaled.join(F.broadcast(single)).withColumn("z", F.explode(F.when(F.col("top") == 0, F.sequence(F.lit(0), F.lit(layers - 1))).otherwise(F.array("band"))))
    voxels = cells.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    return voxels.join(spread.select("x", "y", "z", "moisture"), ["x", "y", "z"], "left").withColumn("moisture", F.coalesce("moisture", F.lit(default)))


def extent(meta: DataFrame, resolution: float) -> DataFrame:
    """Bounds of all rasters and the grid that covers them."""
    out = meta.agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
    cells = lambda a, b: F.floor((F.col(b) - F.col(a)) / resolution).cast("long")
    return out.select("*", cells("x_min", "x_max").alias("width"), cells("y_min", "y_max").alias("height"))


def to_pixel(x: Column, y: Column, x0: Column, top: Column, size: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(row, col) of a point, clipped to the raster."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, F.floor(v).cast("int")))
    return clip((top - y) / size, height), clip((x - x0) / size, width)


def find_elevation(spark: SparkSession, base: str, area: str, datasets: list[str], name: str = "dem") -> str | None:
    """The first elevation raster there is: of the base, the area, its rasters, then each dataset."""
    jvm = spark.sparkContext._jvm
    for path in (f"{base}/{name}", f"{base}/{area}/{name}", f"{base}/{area}/rasters/{name}", *(f"{base}/{area}/{d}/{name}" for d in datasets)):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    return None
