"""Height bins, normalised return density and plant area density, by profile and by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from emberline.functions import heights as H
from emberline.sources.points import cell


def height_bins(points: DataFrame, size: float = 2.0) -> DataFrame:
    """(bin, n): counts of occupied bins; the top edge belongs to the last bin."""
    top = points.agg(F.greatest(F.lit(1), F.ceil(F.max("z") / size)).alias("bins"))  # one row
    index = H.closed_bin_index(F.col("z"), F.col("bins"), size)
    return points.join(F.broadcast(top)).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))


def with_support(bins: DataFrame, percent: float = 0.1, least: int = 5) -> DataFrame:
    """Bins with total, threshold and whether they have enough points."""
    total = bins.agg(F.sum("n").alias("total"))  # one row
    need = F.greatest(F.lit(least), F.floor(F.col("total") * percent / 100).cast("int"))
    return bins.join(F.broadcast(total)).withColumn("threshold", need).withColumn("included", F.col("n") >= F.col("threshold"))


def profile(bins: DataFrame, size: float = 2.0, kappa: float = 0.6, percent: float = 0.1) -> DataFrame:
    """(bin, n, cum_n, nrd, transmittance, pad) over the supported bins, from the ground up."""
    kept = with_support(bins, percent).where("included")
    cum = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as bins
    out = kept.select("bin", "n", cum.alias("cum_n")).withColumn("nrd", F.col("n") / F.col("cum_n"))
    return out.select("*", H.transmittance(F.col("nrd")).alias("transmittance"), H.plant_area_density(F.col("nrd"), kappa, size).alias("pad"))


def cell_bins(points: DataFrame, size: float = 2.0, resolution: float = 5.0) -> DataFrame:
    """(gx, gy, bin, n) of occupied voxels, half-open bins."""
    return points.groupBy(cell("x", resolution).alias("gx"), cell("y", resolution).alias("gy"), H.bin_index(F.col("z"), size).alias("bin")).agg(F.count("*").alias("n"))


def cell_density(voxels: DataFrame) -> DataFrame:
    """Adds nrd: the count of a voxel over the running count from the ground of its cell."""
    up = Window.partitionBy("gx", "gy").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return voxels.withColumn("nrd", F.col("n") / F.sum("n").over(up))


def cell_pad(points: DataFrame, size: float = 2.0, resolution: float = 5.0, kappa: float = 0.6) -> DataFrame:
    """(gx, gy, bin, n, nrd, pad) of occupied voxels: the flagship plan.

    Points never move: the first shuffle takes partial counts, the second occupied voxels.
    """
    return cell_density(cell_bins(points, size, resolution)).withColumn("pad", H.plant_area_density(F.col("nrd"), kappa, size))


def strata(points: DataFrame, size: float = 2.0) -> DataFrame:
    """(stratum, n)."""
    bins = points.groupBy(H.bin_index(F.col("z"), size).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy(H.stratum(F.col("bin") * size).alias("stratum")).agg(F.sum("n").alias("n"))


def height_facts(points: DataFrame) -> DataFrame:
    """(n, min_z, max_z, mean_z, std_z, density) of a cloud."""
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return points.agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), (F.count("*") / area).alias("density"))


def gap_bins(bins: DataFrame) -> DataFrame:
    """Supported bins and the empty ones that a raster over their edges would add."""
    edges = bins.select("bin", F.lag("bin").over(Window.orderBy("bin")).alias("before"))  # as many rows as bins
    gaps = edges.where(F.col("bin") > F.col("before") + 1).select((F.col("before") + 1).alias("first_bin"), F.col("bin").alias("end_bin"), F.lit(True).alias("gap"))
    return bins.select(F.col("bin").alias("first_bin"), (F.col("bin") + 1).alias("end_bin"), F.lit(False).alias("gap")).unionByName(gaps)
