"""Queries on configuration, sources, storage and the choices of a run."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberline import config as C
from emberline.functions import fire, heights
from emberline.operators import filters, raster, simulate, tiles
from emberline.plans import base as B
from emberline.plans import fire_queries as R
from emberline.plans import tile_queries as T
from emberline.scratch import new_path
from emberline.sources import geotiff, las, points as P, store

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: B.rounded(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {T._AREAS} SELECT id, preset FROM chosen")
def q_preset_choice(spark, d):
    return T.areas(spark, d).select("id", C.preset_choice(F.col("area"), F.col("density"), F.col("wind")).alias("preset"))


@query("SELECT l_suppkey AS id, count(*) AS cells, CASE WHEN count(*) > 580 THEN ceil(5.0::DOUBLE * count(*) / 580 * 2) / 2 ELSE 5.0::DOUBLE END AS resolution FROM lineitem GROUP BY 1")
def q_coarser_resolution(spark, d):
    """The resolution at which as many cells as a supplier has lines are 580 at most."""
    sizes = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("cells"))
    return sizes.select("id", "cells", fire.coarser_resolution(F.lit(5.0), F.col("cells"), F.lit(580)).alias("resolution"))


@query("SELECT l_orderkey, sum(l_quantity)::BIGINT AS step, (sum(l_quantity)::BIGINT * 5 // 60) || 'h ' || (sum(l_quantity)::BIGINT * 5 % 60) || 'm' AS after FROM lineitem GROUP BY 1")
def q_duration(spark, d):
    """The time that as many steps as an order has pieces take."""
    steps = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("step"))
    return steps.select("l_orderkey", "step", fire.duration(F.col("step")).alias("after"))


@query(f"WITH {B.VEG} SELECT DISTINCT CASE WHEN floor(z / 2) % 2 = 0 THEN 'site_nrd_' || (floor(z / 2) * 2)::BIGINT || 'm_to_x.tif' ELSE (floor(z / 2) * 2)::BIGINT || '-y.tif' END AS name, CASE WHEN floor(z / 2) % 2 = 0 THEN floor(z / 2) * 2.0::DOUBLE ELSE -99.0 END AS height FROM veg")
def q_raster_height(spark, d):
    """Heights from the names of the rasters of all bins; -99 where a name has none."""
    low = (F.floor(F.col("z") / 2) * 2).cast("string")
    named = F.when(F.floor(F.col("z") / 2) % 2 == 0, F.concat(F.lit("site_nrd_"), low, F.lit("m_to_x.tif"))).otherwise(F.concat(low, F.lit("-y.tif")))
    return B.veg(spark, d).select(named.alias("name")).distinct().select("name", F.coalesce(heights.file_height(F.col("name")), F.lit(-99.0)).alias("height"))


@query("SELECT l_returnflag AS dataset, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 25830 WHEN 'N' THEN 4326 ELSE -1 END::BIGINT AS epsg FROM lineitem GROUP BY 1")
def q_epsg(spark, d):
    """Points by their dataset with the code of its coordinates; -1: unknown."""
    known = [("A", 'PROJCS["x",AUTHORITY["EPSG","25830"]]'), ("N", 'GEOGCS["WGS 84",DATUM["d",AUTHORITY["EPSG","6326"]],AUTHORITY["EPSG","4326"]]'), ("R", "LOCAL_CS[]")]
    points = P.lineitem_points(spark, d, "l_returnflag").withColumnRenamed("l_returnflag", "dataset")
    named = P.with_epsg(points, spark.createDataFrame(known, "dataset string, wkt string"))
    return named.groupBy("dataset", F.coalesce("epsg", F.lit(-1)).alias("epsg")).agg(F.count("*").alias("n"))


@query(f"WITH {B.VEG} SELECT classification::BIGINT AS classification, count(*) AS n, 25830::BIGINT AS epsg, round(min(x), 2) AS min_x, round(max(y), 2) AS max_y, round(avg(z), 2) + 0.0::DOUBLE AS mean_z FROM veg GROUP BY 1")
def q_las_points(spark, d):
    """All points written as LAS files by ranges of a space-filling curve and read back by ranges of points."""
    folder, wkt = new_path(spark, "las"), 'PROJCS["x",AUTHORITY["EPSG","25830"]]'
    las.write_las(B.veg(spark, d).where("classification < 5"), f"{folder}/a", 1e-6, wkt, 0, 5_000)
    las.write_las(B.veg(spark, d).where("classification = 5"), f"{folder}/b", 1e-6, wkt, 6, 5_000)
    found = las.read_las(spark, folder)
    low = lambda c: F.round(c, 2) + F.lit(0.0)
    return found.groupBy("classification").agg(F.count("*").alias("n"), F.max("epsg").alias("epsg"), low(F.min("x")).alias("min_x"), low(F.max("y")).alias("max_y"), low(F.avg("z")).alias("mean_z"))


@query(f"WITH {B.VEG} SELECT classification::BIGINT AS classification, count(*) AS n FROM veg WHERE x BETWEEN 30.5 AND 61.25 AND y BETWEEN 100.25 AND 140.5 GROUP BY 1")
def q_las_box(spark, d):
    """Points of a box from LAS files, of which those beyond it are not read."""
    folder = new_path(spark, "las")
    las.write_las(B.veg(spark, d), folder, 1e-6, file_points=1_000)
    return las.read_las(spark, folder, box=(30.5, 61.25, 100.25, 140.5)).groupBy("classification").agg(F.count("*").alias("n"))


_PADS = f"WITH {B.PAD} SELECT gy::BIGINT AS row, gx::BIGINT AS col, (bin + 1)::BIGINT AS band, round(pad::FLOAT::DOUBLE, 6) AS value FROM pad"


def _pad_rasters(spark, d, one: bool):
    """Density of all height bins as cells of one raster with a band for each, or of one raster for each, and their frames."""
    bin_of = lambda: (F.col("bin") + 1).cast("int")
    name = F.lit("pad") if one else F.concat(F.lit("pad_"), F.lpad(bin_of().cast("string"), 3, "0"))
    cells = B.pad(spark, d).select(name.alias("raster_id"), (bin_of() if one else F.lit(1)).alias("band"), F.col("gy").cast("int").alias("row"), F.col("gx").cast("int").alias("col"), F.col("pad").alias("value"))
    ends = [F.lit(v).cast(t).alias(c) for c, t, v in (("x0", "double", 0), ("top", "double", 200), ("dx", "double", 5), ("dy", "double", 5), ("nodata", "double", -9999), ("epsg", "int", 25830))]
    frames = cells.groupBy("raster_id").agg(F.max("band").alias("bands")).select("raster_id", F.lit(40).alias("width"), F.lit(40).alias("height"), "bands", *ends)
    return cells, frames


@query(_PADS)
def q_geotiff_bands(spark, d):
    """Density of all height bins written as a GeoTIFF with a band for each, and read back without nodata."""
    folder = new_path(spark, "tif")
    geotiff.write_rasters(*_pad_rasters(spark, d, True), folder, side=16)
    return geotiff.read_rasters(spark, folder).where("value IS NOT NULL").select("row", "col", "band", "value")


@query(_PADS + " WHERE gy BETWEEN 10 AND 21 AND gx BETWEEN 5 AND 29 AND bin IN (1, 4)")
def q_geotiff_window(spark, d):
    """Two bands of a window of that raster, from the tiles that hold them."""
    folder = new_path(spark, "tif")
    geotiff.write_rasters(*_pad_rasters(spark, d, True), folder, side=16)
    return geotiff.read_rasters(spark, folder, bands=[2, 5], rows=(10, 22), cols=(5, 30)).where("value IS NOT NULL").select("row", "col", "band", "value")


@query(_PADS)
def q_vrt_stack(spark, d):
    """A raster for each height bin, stacked by a VRT and read as one table."""
    folder = new_path(spark, "vrt")
    geotiff.write_rasters(*_pad_rasters(spark, d, False), folder, side=16)
    geotiff.write_vrt(spark, geotiff.read_frames(spark, folder), f"{folder}/pad.vrt")
    return geotiff.read_vrt(spark, folder).where("value IS NOT NULL").select("row", "col", "band", "value")


@query(f"WITH {B.PAD} SELECT 40::BIGINT AS width, 40::BIGINT AS height, 1::BIGINT AS bands, 0.0::DOUBLE AS x0, 200.0::DOUBLE AS top, 5.0::DOUBLE AS dx, 5.0::DOUBLE AS dy, -9999.0::DOUBLE AS nodata, 25830::BIGINT AS epsg, 'pad_' || lpad((bin + 1)::VARCHAR, 3, '0') || '.tif' AS raster_id FROM pad GROUP BY bin")
def q_geotiff_frame(spark, d):
    """What the headers of the rasters of the height bins say."""
    folder = new_path(spark, "tif")
    geotiff.write_rasters(*_pad_rasters(spark, d, False), folder, side=16)
    return geotiff.read_frames(spark, folder)


@query(f"WITH {B.CELLS} SELECT x::BIGINT AS x, y::BIGINT AS y FROM cells ORDER BY {B.draw(repr('42'), repr('top'), 'x', 'y')}, x, y LIMIT 25")
def q_top_random(spark, d):
    return filters.top_random(B.cells(spark, d), 25, "x", "y")


@query(f"WITH {R._SNAPS} SELECT step::BIGINT AS step, count(*) AS voxels, count(*) FILTER (state = 1) AS burning FROM snaps WHERE step % 2 = 0 OR step = {R._STEPS} GROUP BY step")
def q_recorded_steps(spark, d):
    return filters.recorded_steps(R._snaps(spark, d), 2).groupBy("step").agg(F.count("*").alias("voxels"), F.count_if(F.col("state") == 1).alias("burning"))


@query(f"WITH {R._RUN} SELECT {R._STEPS}::BIGINT AS step, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, state::BIGINT AS state, round(fuel, 6) + 0.0::DOUBLE AS fuel FROM l{R._STEPS} WHERE state > 0")
def q_reopened_run(spark, d):
    """A run whose first steps are stored and which goes on from what is read back."""
    from emberline.scratch import stage

    path, static = new_path(spark, "history"), stage(B.static(spark, d), "static")
    history: list = []
    simulate.run(R._lit(spark, d), static, R._C, B.SIDE, B.SIDE, 2, history=history)
    store.write_history(simulate.snapshots(history), path)
    step, state = store.reopen(spark, path)
    out = simulate.run(state, static, R._C, B.SIDE, B.SIDE, R._STEPS - step, first=step)
    return out.where("state > 0").select(F.lit(R._STEPS).alias("step"), "x", "y", "z", "state", "fuel")


@query("SELECT DISTINCT 'sup' || l_suppkey || '/x_nrd_values.csv' AS path FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1)")
def q_with_companions(spark, d):
    """Tables of suppliers beside which there is a raster, which those with a large first line have."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    path = lambda name: F.concat(F.lit("sup"), F.col("l_suppkey").cast("string"), name).alias("path")
    rasters = lines.where("l_quantity > 48").select(path(F.when((F.col("l_quantity") > 49) & (F.col("l_linenumber") == 1), F.concat(F.lit("/nrd_rasters/"), F.col("l_partkey").cast("string"), F.lit(".TIF"))).otherwise(F.lit("/nrd_rasters/notes.txt"))))
    return filters.with_companions(lines.select(path(F.lit("/x_nrd_values.csv"))).distinct(), rasters.distinct())


@query("SELECT l_suppkey AS dataset, count(*) AS total, count(*) FILTER (l_linenumber BETWEEN 3 AND 6) AS succeeded, count(*) FILTER (NOT l_linenumber BETWEEN 3 AND 6) AS failed FROM lineitem GROUP BY 1")
def q_outcomes(spark, d):
    """Outcomes by supplier; lines of number 7 have none, which is a failure."""
    n = F.col("l_linenumber")
    runs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("dataset"), F.when(n < 7, n >= 3).alias("ok"))
    return filters.outcomes(runs, "dataset")


@query(f"WITH {B.COUNTS} SELECT bin // 4 AS \"group\", min(bin) AS first_layer, max(bin) AS last_layer, count(DISTINCT bin) AS layers FROM cb WHERE n > 1 GROUP BY 1")
def q_layer_groups(spark, d):
    """The height bins that are taken in together, four at a time."""
    from emberline.operators.structure import cell_bins

    return raster.layer_groups(cell_bins(B.positive(spark, d)).where("n > 1").select(F.col("bin").cast("int").alias("z")), 4)


@query(f"WITH {B.CELLS} SELECT DISTINCT (x // 5 - 1)::BIGINT AS tile_x, (y // 6 - 1)::BIGINT AS tile_y, x // 5 BETWEEN 1 AND 5 AND y // 6 BETWEEN 1 AND 4 AS valid FROM cells")
def q_valid_tiles(spark, d):
    at = lambda c, n: (F.floor(F.col(c) / n) - 1).alias(f"tile_{c}")
    return tiles.valid_tiles(B.cells(spark, d).select(at("x", 5), at("y", 6)).distinct(), 5, 4)


_LEVELS = B.STATES + ", lv AS (SELECT l.range AS level, x // (1 << l.range)::INT AS x, y // (1 << l.range)::INT AS y, state FROM range(3) l, flat WHERE x % (1 << l.range)::INT = 0 AND y % (1 << l.range)::INT = 0), ch AS (SELECT x, y, 1 + n % 2 AS state FROM flat WHERE n % 7 = 3)"


@query(f"WITH {_LEVELS}, n AS (SELECT l.range AS level, x // (1 << l.range)::INT AS x, y // (1 << l.range)::INT AS y, max_by(state, y * 1000 + x) AS new FROM ch, range(3) l GROUP BY 1, 2, 3) SELECT level, x::BIGINT AS x, y::BIGINT AS y, coalesce(new, state)::BIGINT AS state FROM lv LEFT JOIN n USING (level, x, y)")
def q_write_through(spark, d):
    """A pyramid of states after some cells of its finest level have changed."""
    flat = B.states(spark, d)
    changed = flat.where("n % 7 = 3").select("x", "y", (F.col("n") % 2 + 1).cast("int").alias("state"))
    return raster.write_through(raster.pyramid(flat.drop("n"), 3), changed)


@query(f"WITH {B.POINTS} SELECT floor(x / 40)::BIGINT AS tile_x, floor(y / 40)::BIGINT AS tile_y, count(*) AS points, round(max(z), 6) + 0.0::DOUBLE AS top FROM points WHERE (floor(x / 40), floor(y / 40)) NOT IN ((1, 1), (2, 3)) GROUP BY ALL")
def q_tile_store(spark, d):
    """Tiles of points stored, one column of them replaced and two removed, as the store gives them back."""
    from emberline.sources.store import TileStore

    kept = TileStore(spark, new_path(spark, "tiles"))
    named = tiles.tile_of(B.points(spark, d), 40)
    kept.put(named.where("tile_x < 3"))
    kept.put(named.where("tile_x >= 2"))
    kept.remove(1, 1), kept.remove(2, 3)
    return spark.read.parquet(kept.root).groupBy("tile_x", "tile_y").agg(F.count("*").alias("points"), F.max("z").alias("top"))


@query(f"WITH {B.POINTS} SELECT count(DISTINCT (floor(x / 40), floor(y / 40))) - 2 AS tiles, true AS has_bytes FROM points")
def q_store_totals(spark, d):
    from emberline.sources.store import TileStore

    kept = TileStore(spark, new_path(spark, "tiles"))
    kept.put(tiles.tile_of(B.points(spark, d), 40))
    kept.remove(0, 0), kept.remove(4, 4)
    return kept.info().select("tiles", (F.col("bytes") > 0).alias("has_bytes"))


_RAW = [math.exp(-0.5 * (k / 0.5) ** 2) for k in range(-2, 3)]
_TAPS = ", ".join(f"({k}, {w / sum(_RAW)!r}::DOUBLE)" for k, w in zip(range(-2, 3), _RAW, strict=True))


def _mirrored(axis: str, of: str, value: str) -> str:
    """SQL of one pass over an axis of 40, what lies beyond an edge being as far before it."""
    at = f"(({axis} + k + 78) % 78)"
    other = "y" if axis == "x" else "x"
    return f"SELECT a.{other}, a.{axis}, sum(w * b.{value}) AS v FROM (SELECT x, y, w, CASE WHEN {at} < 40 THEN {at} ELSE 78 - {at} END AS at FROM {of}, (VALUES {_TAPS}) t(k, w)) a JOIN {of} b ON b.{axis} = a.at AND b.{other} = a.{other} GROUP BY a.x, a.y"


@query(f"WITH {B.POINTS}{B.SURFACE}, once AS ({_mirrored('x', 'surface', 'elev')}), twice AS ({_mirrored('y', 'once', 'v')}) SELECT (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, round(avg(v), 6) + 0.0::DOUBLE AS value FROM twice GROUP BY 1, 2")
def q_resize_mean(spark, d):
    """The ground at half its resolution, smoothed by half a cell before."""
    return raster.resize(B.surface(spark, d).withColumnRenamed("elev", "value"), 40, 40, 20, 20)
