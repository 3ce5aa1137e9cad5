"""Queries on rasters and voxels: fuel, moisture, terrain, wind and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import fire
from emberline.operators import raster, terrain, voxel
from emberline.plans import base as B
from emberline.sources import points as P
from emberline.sources import rasters

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: B.rounded(f(spark, d))
        ORACLE[f.__name__] = sql
        return f

    return add


@query(B.final(B.FUEL, "x y z", "fuel", source="fuel"))
def q_voxel_fuel(spark, d):
    return B.fuel(spark, d)


@query(f"WITH {B.FUEL} SELECT z::BIGINT AS z, round(min(fuel), 6) AS min_fuel, round(max(fuel), 6) AS max_fuel, round(avg(fuel), 6) AS mean_fuel FROM fuel GROUP BY ALL")
def q_fuel_stats(spark, d):
    return voxel.fuel_facts(B.fuel(spark, d))


@query(B.final(B.FUEL + B.CONN, "x y z", "conn_up", source="conn"))
def q_connectivity(spark, d):
    return voxel.with_connectivity(B.fuel(spark, d)).select("x", "y", "z", "conn_up")


@query(B.final(B.CELLS + B.MOISTURE, "x y", "moisture", source="moist"))
def q_moisture(spark, d):
    return B.moisture(spark, d)


@query(f"WITH {B.COUNTS}, lo AS (SELECT bin, min(n) AS a, max(n) AS b FROM cb GROUP BY bin) SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, bin, round(CASE WHEN b > a THEN 0.0::DOUBLE + (n - a) / (b - a)::DOUBLE * 10 ELSE 0.0 END, 6) + 0.0::DOUBLE AS fuel_raw FROM cb JOIN lo USING (bin)")
def q_raster_normalise(spark, d):
    from emberline.operators.structure import cell_bins

    counted = cell_bins(B.positive(spark, d)).withColumn("fuel_raw", F.col("n").cast("double"))
    return raster.min_max(counted, "fuel_raw", 0.0, 10.0, 0.0, ["bin"]).select("gx", "gy", "bin", "fuel_raw")


_BANDS = B.STATES + ", bands AS (SELECT x, y, b.band, CASE WHEN n % 11 = 0 THEN -9999.0::DOUBLE ELSE ((n * (b.band + 2) + x) % 23)::DOUBLE END AS value FROM flat, (VALUES (0), (1), (2)) b(band)), raw AS (SELECT *, CASE WHEN value = -9999 THEN 0.3::DOUBLE ELSE value END AS r FROM bands), sc AS (SELECT x, y, band, 0.1::DOUBLE + (r - min(r) OVER (PARTITION BY band)) / (max(r) OVER (PARTITION BY band) - min(r) OVER (PARTITION BY band)) * 0.8::DOUBLE AS m FROM raw)"


@query(f"WITH {_BANDS} SELECT cells.x::BIGINT AS x, cells.y::BIGINT AS y, z.range::BIGINT AS z, round(coalesce(m, 0.3::DOUBLE), 6) AS moisture FROM cells CROSS JOIN range(5) z LEFT JOIN sc ON sc.x = cells.x AND sc.y = cells.y AND band = z.range")
def q_moisture_bands(spark, d):
    bands = B.states(spark, d).withColumn("band", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    value = F.when(F.col("n") % 11 == 0, -9999.0).otherwise(((F.col("n") * (F.col("band") + 2) + F.col("x")) % 23).cast("double"))
    return rasters.read_moisture(bands.select("band", "x", "y", value.alias("value")), B.cells(spark, d), 5)


@query(f"WITH {B.POINTS}{B.SURFACE} SELECT x::BIGINT AS x, y::BIGINT AS y, round(coalesce(elev, (SELECT min(elev) FROM lowest)), 6) + 0.0::DOUBLE AS value FROM cells LEFT JOIN lowest USING (x, y)")
def q_nodata_least(spark, d):
    """A raster of the ground whose cells without a point are nodata."""
    holes = B.cells(spark, d).join(B.ground(spark, d), ["x", "y"], "left").select("x", "y", F.coalesce("elev", F.lit(-9999.0)).alias("value"))
    return rasters.fill_with_least(holes).select("x", "y", "value")


@query(B.final(B.POINTS + B.GRADIENT.format(t="5.0::DOUBLE"), "x y", "elev dx dy slope aspect", source="g"))
def q_terrain_gradient(spark, d):
    return terrain.gradient(B.surface(spark, d)).select("x", "y", "elev", "dx", "dy", "slope", "aspect")


@query(f"WITH {B.POINTS}{B.GRADIENT.format(t='1.0::DOUBLE')} SELECT x::BIGINT AS x, y::BIGINT AS y, ravine FROM g")
def q_barranco(spark, d):
    return terrain.neighbours(B.surface(spark, d)).select("x", "y", terrain.ravine(threshold=1.0).alias("ravine"))


@query(B.final(B.WIND, "x y", "dir speed u v", source="wind"))
def q_wind_field(spark, d):
    return B.wind(spark, d).select("x", "y", "dir", "speed", "u", "v")


@query(f"WITH {B.WIND} SELECT count(*) AS cells, count(*) FILTER (ravine) AS ravines, round(min(speed), 6) AS min_speed, round(max(speed), 6) AS max_speed, round(min(dir), 6) AS min_dir, round(max(dir), 6) AS max_dir FROM wind")
def q_wind_facts(spark, d):
    return terrain.wind_facts(B.wind(spark, d))


@query(f"WITH {B.CELLS} SELECT x::BIGINT AS x, y::BIGINT AS y, 1.0::DOUBLE AS dir, 0.5::DOUBLE AS speed, round(0.5 * cos(1.0), 6) AS u, round(0.5 * sin(1.0), 6) AS v FROM cells")
def q_uniform_wind(spark, d):
    return terrain.uniform_wind(B.cells(spark, d), 1.0, 0.5)


#: towards which neighbour a cell looks, from its place, and how steep the ground is there
_STEPS = "(SELECT x, y, x % 7 - 3 AS dx, y % 7 - 3 AS dy, slope FROM g)"
_SLOPES = B.POINTS + B.GRADIENT.format(t="5.0::DOUBLE")
_ANGLE = "abs((degrees(atan2(dy::DOUBLE, dx::DOUBLE)) - 30.0 + 180.0) - floor((degrees(atan2(dy::DOUBLE, dx::DOUBLE)) - 30.0 + 180.0) / 360.0) * 360.0 - 180.0)"


def _steps(spark, d):
    return terrain.gradient(B.surface(spark, d)).select("x", "y", "slope", (F.col("x") % 7 - 3).alias("dx"), (F.col("y") % 7 - 3).alias("dy"))


@query(f"WITH {_SLOPES} SELECT x::BIGINT AS x, y::BIGINT AS y, dx::BIGINT AS dx, dy::BIGINT AS dy, round(CASE WHEN dx = 0 AND dy = 0 THEN 1.0::DOUBLE WHEN {_ANGLE} <= 90 THEN 1.0::DOUBLE + 0.7::DOUBLE * (1.0::DOUBLE - {_ANGLE} / 90) ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.7::DOUBLE * ({_ANGLE} - 90) / 90) END, 6) AS factor FROM {_STEPS}")
def q_wind_factor(spark, d):
    return _steps(spark, d).select("x", "y", "dx", "dy", fire.wind_factor(F.col("dx"), F.col("dy"), F.lit(30.0), F.lit(0.7)).alias("factor"))


@query(f"WITH {_SLOPES} SELECT x::BIGINT AS x, y::BIGINT AS y, dx::BIGINT AS dx, dy::BIGINT AS dy, round(CASE WHEN dx = 0 AND dy = 0 THEN 1.0::DOUBLE WHEN {_ANGLE} <= 90 THEN 1.0::DOUBLE + 0.3::DOUBLE * slope * (1.0::DOUBLE - {_ANGLE} / 90) ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * slope * ({_ANGLE} - 90) / 90 * 0.5::DOUBLE) END, 6) AS factor FROM {_STEPS}")
def q_terrain_factor(spark, d):
    return _steps(spark, d).select("x", "y", "dx", "dy", fire.terrain_factor(F.col("dx"), F.col("dy"), F.lit(30.0), F.col("slope"), 0.3).alias("factor"))


@query(f"WITH {B.STATES} SELECT x::BIGINT AS x, y::BIGINT AS y, n % 9 AS n, round(1.0 / (1.0 + exp(-1.5 * (n % 9 - 1.0))), 6) AS p FROM flat")
def q_sigmoid(spark, d):
    n = F.col("n") % 9
    return B.states(spark, d).select("x", "y", n.alias("n"), fire.sigmoid(n).alias("p"))


@query("SELECT event_id, event_id % 25 * 15 AS bearing, round(radians((90.0::DOUBLE - event_id % 25 * 15) - floor((90.0::DOUBLE - event_id % 25 * 15) / 360) * 360), 6) AS angle FROM events")
def q_wind_units(spark, d):
    bearing = F.col("event_id") % 25 * 15
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", bearing.alias("bearing"), fire.met_degrees_to_radians(bearing).alias("angle"))


#: the voxels that hold points, and the columns of cells
_VOXELS = B.COUNTS + ", full_ones AS (SELECT gx AS x, gy AS y, bin AS z FROM cb)"


def _voxels(spark, d):
    from emberline.operators.structure import cell_bins

    return cell_bins(B.positive(spark, d)).select(F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("bin").cast("int").alias("z"))


@query(f"WITH {_VOXELS} SELECT x::BIGINT AS x, y::BIGINT AS y, z, round(0.1::DOUBLE + 9.9::DOUBLE * {B.draw(repr('42'), repr('fuel'), 'x', 'y', 'z')}, 6) AS fuel FROM full_ones")
def q_fuel_random(spark, d):
    return P.random_fuel(_voxels(spark, d))


@query(f"WITH {_VOXELS} SELECT x::BIGINT AS x, y::BIGINT AS y, z, round((0.1::DOUBLE + 9.9::DOUBLE * {B.draw(repr('42'), repr('fuel'), 'x', 'y', 'z')}) * greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.8::DOUBLE * z / 15), 6) AS fuel FROM full_ones")
def q_fuel_gradient(spark, d):
    return P.generate_fuel(_voxels(spark, d), "gradient", 15)


@query(f"WITH {_VOXELS} SELECT x::BIGINT AS x, y::BIGINT AS y, z, CASE z WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS fuel FROM full_ones")
def q_fuel_layers(spark, d):
    return P.generate_fuel(_voxels(spark, d), "layer_specific", 15, values=[0.9, 0.7, 0.4])


@query(f"WITH {_VOXELS} SELECT x::BIGINT AS x, y::BIGINT AS y, z, round(1.0::DOUBLE - z / 15.0::DOUBLE, 6) + 0.0::DOUBLE AS fuel FROM full_ones")
def q_fuel_default(spark, d):
    return P.generate_fuel(_voxels(spark, d), "default", 15)


def _disc(k: int) -> str:
    at = lambda n: B.draw(repr("42"), repr(n), repr(str(k)))
    cx, cy, r = f"floor({at('cx')} * 40)", f"floor({at('cy')} * 40)", f"floor(20 + {at('r')} * 80)"
    return f"CASE WHEN (x - {cx}) ** 2 + (y - {cy}) ** 2 <= {r} ** 2 THEN {B.draw(repr('42'), repr('disc'), repr(str(k)), 'x', 'y')} * 0.5::DOUBLE ELSE 0 END"


@query(f"WITH {B.CELLS} SELECT x::BIGINT AS x, y::BIGINT AS y, round(least(1.0::DOUBLE, {B.draw(repr('42'), repr('base'), 'x', 'y')} * 0.5::DOUBLE + {' + '.join(_disc(k) for k in range(5))}), 6) AS vegetation FROM cells")
def q_benchmark_forest(spark, d):
    return P.benchmark_forest(B.cells(spark, d), 40, 40)


@query(f"WITH {B.CELLS} SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN (x - 20) ** 2 + (y - 20) ** 2 < 4 THEN 1 ELSE 0 END::BIGINT AS state, 1.0::DOUBLE AS vegetation, 0.0::DOUBLE AS moisture FROM cells")
def q_disc_seed(spark, d):
    return P.disc_seed(B.cells(spark, d), *B.size(spark, d))


_TARGET = "t AS (SELECT a.range::INT AS nx, b.range::INT AS ny FROM range(25) a, range(25) b), s AS (SELECT nx, ny, {x} AS sx, {y} AS sy FROM t), f AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, least(floor(sx)::INT + 1, 39) AS x1, least(floor(sy)::INT + 1, 39) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s)"
_FOUR = "SELECT nx::BIGINT AS x, ny::BIGINT AS y, round(a.elev * (1 - fx) * (1 - fy) + b.elev * fx * (1 - fy) + c.elev * (1 - fx) * fy + e.elev * fx * fy, 6) + 0.0::DOUBLE AS value FROM f JOIN surface a ON a.x = x0 AND a.y = y0 JOIN surface b ON b.x = x1 AND b.y = y0 JOIN surface c ON c.x = x0 AND c.y = y1 JOIN surface e ON e.x = x1 AND e.y = y1"
_HALF = "greatest(0.0::DOUBLE, least(39.0::DOUBLE, ({c} + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE))"


@query(f"WITH {B.POINTS}{B.SURFACE}, {_TARGET.format(x=_HALF.format(c='nx'), y=_HALF.format(c='ny'))} {_FOUR}")
def q_bilinear(spark, d):
    return raster.bilinear(B.surface(spark, d).withColumnRenamed("elev", "value"), 40, 40, 25, 25)


@query(f"WITH {B.POINTS}{B.SURFACE}, {_TARGET.format(x='nx * 1.625::DOUBLE', y='ny * 1.625::DOUBLE')} {_FOUR}")
def q_zoom(spark, d):
    return raster.bilinear(B.surface(spark, d).withColumnRenamed("elev", "value"), 40, 40, 25, 25, corners=True)


@query(f"WITH {B.POINTS}{B.SURFACE} SELECT level.range AS level, (x // (2 ** level.range)::INT)::BIGINT AS x, (y // (2 ** level.range)::INT)::BIGINT AS y, round(elev, 6) + 0.0::DOUBLE AS elev FROM surface, range(4) level WHERE x % (2 ** level.range)::INT = 0 AND y % (2 ** level.range)::INT = 0")
def q_pyramid(spark, d):
    return raster.pyramid(B.surface(spark, d), 4).select("level", "x", "y", "elev")


_FLAT = B.STATES


def _flat(spark, d):
    return B.states(spark, d).select("x", "y", "state")


@query(f"WITH {_FLAT} SELECT (x // 3)::BIGINT AS x, (y // 3)::BIGINT AS y, CASE WHEN bool_or(state = 1) THEN 1 WHEN bool_or(state = 2) THEN 2 ELSE 0 END::BIGINT AS state FROM flat WHERE x < 39 AND y < 39 GROUP BY 1, 2")
def q_block_priority(spark, d):
    return raster.block_priority(_flat(spark, d), 3, 40, 40)


@query(f"WITH {_FLAT}, parts AS (SELECT x, y, state FROM flat UNION ALL SELECT x, y, (state + 1) % 3 FROM flat WHERE x < 20) SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN bool_or(state = 1) THEN 1 WHEN bool_or(state = 2) THEN 2 ELSE 0 END::BIGINT AS state FROM parts GROUP BY x, y")
def q_tile_merge_priority(spark, d):
    flat = _flat(spark, d)
    return raster.merge_priority(flat.union(flat.where("x < 20").select("x", "y", ((F.col("state") + 1) % 3).alias("state"))), ("x", "y"))


@query(f"WITH {_FLAT}, parts AS (SELECT x, y, state, 1 AS o FROM flat UNION ALL SELECT x, y, (state + 1) % 3, 2 FROM flat WHERE x < 20) SELECT x::BIGINT AS x, y::BIGINT AS y, max_by(state, o)::BIGINT AS state FROM parts GROUP BY x, y")
def q_tile_merge_last(spark, d):
    flat = _flat(spark, d)
    parts = flat.withColumn("o", F.lit(1)).unionByName(flat.where("x < 20").select("x", "y", ((F.col("state") + 1) % 3).alias("state"), F.lit(2).alias("o")))
    return raster.merge_last(parts, "o", ("x", "y"))


@query(f"WITH {B.POINTS}{B.SURFACE}, parts AS (SELECT x, y, elev AS value, 22 - x AS edge FROM surface WHERE x < 22 UNION ALL SELECT x, y, elev * 2, x - 18 FROM surface WHERE x >= 18), w AS (SELECT *, least(1.0::DOUBLE, (edge + 1) / 5.0::DOUBLE) AS w FROM parts) SELECT x::BIGINT AS x, y::BIGINT AS y, round(sum(w * value) / sum(w), 6) + 0.0::DOUBLE AS value FROM w GROUP BY x, y")
def q_tile_blend(spark, d):
    h = B.surface(spark, d)
    left = h.where("x < 22").select("x", "y", F.col("elev").alias("value"), (F.lit(22) - F.col("x")).alias("edge"))
    return raster.blend(left.union(h.where("x >= 18").select("x", "y", (F.col("elev") * 2).alias("value"), (F.col("x") - 18).alias("edge"))), 4)


@query(f"WITH {_FLAT}, a AS (SELECT DISTINCT x + i AS x, y + j AS y FROM flat, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) m(i, j) WHERE state = 1), a1 AS (SELECT * FROM a WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 39) SELECT x::BIGINT AS x, y::BIGINT AS y FROM a1")
def q_dilate(spark, d):
    return raster.dilate(_flat(spark, d).where("state = 1").select("x", "y"), 40, 40)


def _kernel() -> str:
    import math

    raw = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
    return ", ".join(f"({k}, {w / sum(raw)!r}::DOUBLE)" for k, w in zip(range(-8, 9), raw, strict=True))


@query(f"WITH {_FLAT}, k AS (SELECT * FROM (VALUES {_kernel()}) t(d, w)), a AS (SELECT x + d AS x, y, sum(w * state) AS v FROM flat, k WHERE x + d BETWEEN 0 AND 39 GROUP BY ALL), b AS (SELECT x, y + d AS y, sum(w * v) AS v FROM a, k WHERE y + d BETWEEN 0 AND 39 GROUP BY ALL) SELECT x::BIGINT AS x, y::BIGINT AS y, round(v, 6) AS value FROM b")
def q_smooth(spark, d):
    return raster.smooth(_flat(spark, d).select("x", "y", F.col("state").cast("double").alias("value")), 2.0, 40, 40)


@query(f"WITH {B.POINTS}{B.SURFACE} SELECT round(min(elev), 6) AS min, round(max(elev), 6) AS max, round(avg(elev), 6) AS mean, round(stddev_pop(elev), 6) AS std FROM surface")
def q_raster_statistics(spark, d):
    return raster.statistics(B.surface(spark, d), "elev")


@query(f"WITH {B.POINTS}{B.SURFACE} SELECT x::BIGINT AS x, y::BIGINT AS y, round(elev, 6) + 0.0::DOUBLE AS elev FROM surface WHERE x % 4 = 0 AND y % 4 = 0")
def q_every_nth(spark, d):
    return raster.every_nth(B.surface(spark, d), 4)


@query(f"WITH {B.POINTS}, m AS (SELECT min(floor(x / 5) * 5) AS a, max(ceil(x / 5) * 5) AS b, min(floor(y / 5) * 5) AS c, max(ceil(y / 5) * 5) AS e FROM points) SELECT a AS x_min, b AS x_max, c AS y_min, e AS y_max, floor((b - a) / 5)::BIGINT AS width, floor((e - c) / 5)::BIGINT AS height FROM m")
def q_raster_extent(spark, d):
    """The grid that covers the rasters of all classes."""
    low, high = (lambda c: F.min(F.floor(F.col(c) / 5) * 5).cast("double")), (lambda c: F.max(F.ceil(F.col(c) / 5) * 5).cast("double"))
    each = B.points(spark, d).groupBy("classification").agg(low("x").alias("x_min"), high("x").alias("x_max"), low("y").alias("y_min"), high("y").alias("y_max"))
    return rasters.extent(each, 5.0)
