"""Queries on points: filters, bins, density and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import heights as H
from emberline.operators import filters, joins, raster, structure, tin
from emberline.plans import base as B
from emberline.sources import points as P
from emberline.sources import rasters

QUERIES, ORACLE = {}, {}
_XYZ = ["x", "y", "z", "classification"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: B.rounded(f(spark, d))
        ORACLE[f.__name__] = sql
        return f

    return add


_STATS = ", facts AS (SELECT avg(z) AS mean, stddev_pop(z) AS std, count(*) FILTER (z < 0) AS negatives, 3.0::DOUBLE / sqrt(count(*) / ((max(x) - min(x)) * (max(y) - min(y)))) AS r FROM veg)"
_USUAL = "(negatives = 0 OR z >= -1 OR abs((z - mean) / std) <= 2.5)"
_JUMPS = ", asks AS (SELECT DISTINCT x AS px, y AS py, z AS pz FROM veg WHERE z < 0), jumps AS (SELECT px, py, pz, count(*) > 1 AND max(abs(z - pz)) > any_value(r) * tan(radians(45)) AS jump FROM asks, facts, veg WHERE (x - px) * (x - px) + (y - py) * (y - py) <= r * r GROUP BY ALL)"


@query(B.final(B.VEG, "classification", "x y z", source="veg"))
def q_points_veg(spark, d):
    return B.veg(spark, d).select(_XYZ)


@query(B.final(B.VEG, "classification", "x y z", source="veg WHERE z >= 0"))
def q_filter_simple(spark, d):
    return filters.filter_artefacts(B.veg(spark, d).select(_XYZ), "simple")


@query(B.final(B.VEG + _STATS, "classification", "x y z", source=f"veg, facts WHERE {_USUAL}"))
def q_filter_statistical(spark, d):
    return filters.filter_artefacts(B.veg(spark, d).select(_XYZ), "statistical")


@query(B.final(B.VEG + _STATS + _JUMPS, "classification", "x y z", source="veg LEFT JOIN jumps ON px = x AND py = y AND pz = z WHERE NOT (z < 0 AND coalesce(jump, false))"))
def q_local_filter(spark, d):
    return filters.filter_artefacts(B.veg(spark, d).select(_XYZ), "local")


@query(B.final(B.VEG + _STATS + _JUMPS, "classification", "x y z", source=f"facts, veg LEFT JOIN jumps ON px = x AND py = y AND pz = z WHERE NOT (z < 0 AND coalesce(jump, false)) AND {_USUAL}"))
def q_filter_combined(spark, d):
    return filters.filter_artefacts(B.veg(spark, d).select(_XYZ), "combined")


@query(B.final(B.VEG, "classification", "x y z", source="veg WHERE z >= -1"))
def q_filter_min_valid(spark, d):
    return filters.filter_artefacts(B.veg(spark, d).select(_XYZ), "none of these")


@query(B.final(B.POSITIVE, "classification", "x y z", source="pos"))
def q_filter_negatives(spark, d):
    return B.positive(spark, d).select(_XYZ)


@query(B.final(B.POINTS, "classification", "x y z", source="points WHERE classification IN (3, 4, 5) AND z BETWEEN 0 AND 80"))
def q_height_range(spark, d):
    return filters.height_range(B.points(spark, d)).select(_XYZ)


@query(f"WITH {B.VEG} SELECT round(max(z), 6) + 0.0::DOUBLE AS max_z, count(*) FILTER (z < 0) AS negatives, max(z) < 1 AND count(*) FILTER (z < 0) = 0 AS low_canopy FROM veg")
def q_low_canopy(spark, d):
    return filters.low_canopy(B.veg(spark, d))


_BINS = B.POSITIVE + ", top AS (SELECT greatest(1, ceil(max(z) / 2))::BIGINT AS bins FROM pos), hb AS (SELECT least(floor(z / 2)::BIGINT, bins - 1) AS bin, count(*) AS n FROM pos, top GROUP BY ALL)"
_SUPPORT = _BINS + ", sup AS (SELECT *, (sum(n) OVER ())::BIGINT AS total, greatest(5, floor((sum(n) OVER ())::DOUBLE * 0.1 / 100)::INT) AS threshold FROM hb)"
_PROFILE = _SUPPORT + f", prof AS (SELECT bin, n, (sum(n) OVER (ORDER BY bin))::BIGINT AS cum_n FROM sup WHERE n >= threshold), profile AS (SELECT *, n / cum_n::DOUBLE AS nrd, 1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, n / cum_n::DOUBLE)) AS transmittance, {B.PAD_OF.replace('nrd', '(n / cum_n::DOUBLE)')} AS pad FROM prof)"


@query(f"WITH {_BINS} SELECT bin, n, format('{{:.1f}}-{{:.1f}}m', bin * 2.0::DOUBLE, bin * 2.0::DOUBLE + 2) AS label FROM hb")
def q_height_bins(spark, d):
    return structure.height_bins(B.positive(spark, d)).withColumn("label", H.bin_label(F.col("bin")))


@query(f"WITH {_SUPPORT} SELECT bin, n, threshold::BIGINT AS threshold, CASE WHEN n >= threshold THEN 'Included' ELSE 'Excluded (<' || threshold || ' points)' END AS status FROM sup")
def q_height_bins_status(spark, d):
    bins = structure.with_support(structure.height_bins(B.positive(spark, d)))
    status = F.when(F.col("included"), "Included").otherwise(F.concat(F.lit("Excluded (<"), F.col("threshold").cast("string"), F.lit(" points)")))
    return bins.select("bin", "n", "threshold", status.alias("status"))


@query(B.final(_PROFILE, "bin n cum_n", "nrd", source="profile"))
def q_nrd_profile(spark, d):
    return structure.profile(structure.height_bins(B.positive(spark, d))).select("bin", "n", "cum_n", "nrd")


@query(B.final(_PROFILE, "bin", "nrd transmittance pad", source="profile"))
def q_pad_profile(spark, d):
    return structure.profile(structure.height_bins(B.positive(spark, d))).select("bin", "nrd", "transmittance", "pad")


@query(B.final(_PROFILE, "bin", "transmittance", source="profile"))
def q_transmittance(spark, d):
    return structure.profile(structure.height_bins(B.positive(spark, d))).select("bin", "transmittance")


@query(f"WITH {_BINS}, e AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS before FROM hb WHERE bin % 3 > 0) SELECT bin AS first_bin, bin + 1 AS end_bin, false AS gap FROM e UNION ALL SELECT before + 1, bin, true FROM e WHERE bin > before + 1")
def q_gap_bins(spark, d):
    return structure.gap_bins(structure.height_bins(B.positive(spark, d)).where("bin % 3 > 0"))


@query(f"WITH {B.POSITIVE} SELECT CASE WHEN floor(z / 2) * 2 >= 20 THEN 'canopy' WHEN floor(z / 2) * 2 >= 10 THEN 'subcanopy' WHEN floor(z / 2) * 2 >= 5 THEN 'understory' WHEN floor(z / 2) * 2 >= 1 THEN 'shrub' ELSE 'ground' END AS stratum, count(*) AS n FROM pos GROUP BY 1")
def q_strata(spark, d):
    return structure.strata(B.positive(spark, d))


@query(f"WITH {B.VEG} SELECT count(*) AS n, round(min(z), 6) + 0.0::DOUBLE AS min_z, round(max(z), 6) + 0.0::DOUBLE AS max_z, round(avg(z), 6) AS mean_z, round(stddev_pop(z), 6) AS std_z, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 6) AS density FROM veg")
def q_height_facts(spark, d):
    return structure.height_facts(B.veg(spark, d))


_FRAME = B.POSITIVE + ", box AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS e FROM pos), f0 AS (SELECT a - (b - a) * 0.02::DOUBLE AS x0, e + (e - c) * 0.02::DOUBLE AS top, (b - a) * 1.04::DOUBLE AS w, (e - c) * 1.04::DOUBLE AS h FROM box), frame AS (SELECT x0, top, greatest(100, ceil(w / 5))::INT AS width, greatest(100, ceil(h / 5))::INT AS height, w / greatest(100, ceil(w / 5)) AS dx, h / greatest(100, ceil(h / 5)) AS dy FROM f0)"


@query(B.final(_FRAME, "width height", "x0 top dx dy", source="frame"))
def q_raster_frame(spark, d):
    return raster.frame(B.positive(spark, d))


@query(f"WITH {_FRAME} SELECT greatest(0, least(height - 1, floor((top - y) / dy)::INT))::BIGINT AS row, greatest(0, least(width - 1, floor((x - x0) / dx)::INT))::BIGINT AS col, count(*) AS n FROM pos, frame GROUP BY 1, 2")
def q_density_grid(spark, d):
    return raster.density(B.positive(spark, d))


@query(f"WITH {B.COUNTS} SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, bin, n, trunc(n / (max(n) OVER (PARTITION BY bin))::DOUBLE * 255)::BIGINT AS byte FROM cb")
def q_density_byte(spark, d):
    return raster.to_bytes(structure.cell_bins(B.positive(spark, d))).select("gx", "gy", "bin", "n", "byte")


@query(B.final(B.PAD, "gx gy bin n", "nrd", source="pad"))
def q_nrd_cells(spark, d):
    return structure.cell_density(structure.cell_bins(B.positive(spark, d))).select("gx", "gy", "bin", "n", "nrd")


@query(B.final(B.PAD, "gx gy bin n", "nrd pad", source="pad"))
def q_pad_cells(spark, d):
    return B.pad(spark, d)


def _ground(spark, d):
    return B.points(spark, d).where(F.col("classification") == 2).select("x", "y", "z")


_NEAR = B.POINTS + ", ground AS (SELECT x AS gx, y AS gy, z AS gz FROM points WHERE classification = 2), asked AS (SELECT DISTINCT x, y, z FROM points WHERE classification = 5)"


@query(B.final(_NEAR + ", m AS (SELECT x, y, z, min({'d': sqrt((x - gx) ** 2 + (y - gy) ** 2), 'g': gz}) AS b FROM asked, ground GROUP BY ALL), hag AS (SELECT x, y, z, z - b.g AS hag FROM m)", "", "x y z hag", source="hag"))
def q_nn_height(spark, d):
    asked = B.points(spark, d).where(F.col("classification") == 5).select("x", "y", "z").distinct()
    keyed = asked.withColumn("id", F.struct("x", "y", "z"))
    return joins.normalise_heights(keyed, _ground(spark, d)).select("x", "y", "z", "hag")


@query(B.final(_NEAR + ", c AS (SELECT a.range::INT AS gx0, b.range::INT AS gy0 FROM range(40) a, range(40) b), w AS (SELECT gx0, gy0, gz, 1.0::DOUBLE / greatest(sqrt(((gx0 + 0.5) * 5 - gx) ** 2 + ((gy0 + 0.5) * 5 - gy) ** 2), 1e-9) ** 2 AS w FROM c, ground WHERE sqrt(((gx0 + 0.5) * 5 - gx) ** 2 + ((gy0 + 0.5) * 5 - gy) ** 2) <= 22), dtm AS (SELECT gx0 AS gx, gy0 AS gy, sum(w * gz) / sum(w) AS elev FROM w GROUP BY ALL)", "gx gy", "elev", source="dtm"))
def q_idw_dtm(spark, d):
    cells = B.cells(spark, d).select(F.col("x").alias("gx"), F.col("y").alias("gy"))
    return joins.terrain_model(_ground(spark, d), cells)


#: one ground point, the mean, for each square of 20 m
_THIN = B.POINTS + ", g AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, row_number() OVER (ORDER BY avg(x), avg(y)) AS i FROM points WHERE classification = 2 GROUP BY floor(x / 20), floor(y / 20))"
#: every three points whose circle holds no other, counter-clockwise
_TIN = _THIN + """, three AS (SELECT a.i AS a, b.i AS b, c.i AS c, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, c.x AS x3, c.y AS y3, c.z AS z3, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS w FROM g a JOIN g b ON a.i < b.i JOIN g c ON b.i < c.i),
circle AS (SELECT *, ((x2 - x1) ** 2 + (y2 - y1) ** 2) * (y3 - y1) - ((x3 - x1) ** 2 + (y3 - y1) ** 2) * (y2 - y1) AS mx, ((x3 - x1) ** 2 + (y3 - y1) ** 2) * (x2 - x1) - ((x2 - x1) ** 2 + (y2 - y1) ** 2) * (x3 - x1) AS my FROM three WHERE w <> 0),
tin AS (SELECT * FROM circle WHERE NOT EXISTS (SELECT 1 FROM g WHERE i NOT IN (a, b, c) AND (x - x1 - mx / (2 * w)) ** 2 + (y - y1 - my / (2 * w)) ** 2 < (mx / (2 * w)) ** 2 + (my / (2 * w)) ** 2)),
asked AS (SELECT DISTINCT x, y, z FROM points WHERE classification = 5),
shares AS (SELECT x, y, z, ((x3 - x2) * (y - y2) - (y3 - y2) * (x - x2)) / w AS wa, ((x1 - x3) * (y - y3) - (y1 - y3) * (x - x3)) / w AS wb, ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / w AS wc, z1, z2, z3 FROM asked, tin),
met AS (SELECT x, y, z, max({'w': least(wa, wb, wc), 'h': wa * z1 + wb * z2 + wc * z3}) AS best FROM shares WHERE least(wa, wb, wc) >= -1e-9 GROUP BY ALL),
hag AS (SELECT asked.x, asked.y, asked.z, best.h AS ground, asked.z - best.h AS hag FROM asked LEFT JOIN met USING (x, y, z))"""


def _thin_ground(spark, d):
    square = [F.floor(F.col(c) / 20).alias(f"s{c}") for c in "xy"]
    return _ground(spark, d).groupBy(*square).agg(*[F.avg(c).alias(c) for c in "xyz"]).select("x", "y", "z")


@query(B.final(_TIN, "", "x y z ground hag", source="hag"))
def q_tin_height(spark, d):
    """Heights over the triangulated ground, null beyond it."""
    asked = B.points(spark, d).where(F.col("classification") == 5).select("x", "y", "z").distinct()
    return tin.normalise_by_tin(asked, _thin_ground(spark, d), rows=40).select("x", "y", "z", "ground", "hag")


@query(f"WITH {_TIN} SELECT round(sum(abs(w)) / 2, 3) AS area, count(*) AS triangles, round(max(greatest(z1, z2, z3) - least(z1, z2, z3)), 6) AS steepest FROM tin")
def q_tin_ground(spark, d):
    """What the triangles of the thinned ground cover, how many there are, and the widest span of heights in one."""
    found = tin.triangulate(_thin_ground(spark, d), rows=40)
    w = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))
    span = F.greatest("az", "bz", "cz") - F.least("az", "bz", "cz")
    return found.agg(F.round(F.sum(w) / 2, 3).alias("area"), F.count("*").alias("triangles"), F.max(span).alias("steepest"))


@query(B.final(B.POINTS + ", dtm AS (SELECT floor(x / 5)::INT AS gx, floor(y / 5)::INT AS gy, avg(z) AS elev FROM points WHERE classification = 2 GROUP BY ALL), p AS (SELECT DISTINCT x, y, z FROM points WHERE classification = 5), hag AS (SELECT p.*, z - elev AS hag FROM p LEFT JOIN dtm ON gx = floor(x / 5)::INT AND gy = floor(y / 5)::INT)", "", "x y z hag", source="hag"))
def q_over_terrain(spark, d):
    model = _ground(spark, d).groupBy(P.cell("x").alias("gx"), P.cell("y").alias("gy")).agg(F.avg("z").alias("elev"))
    asked = B.points(spark, d).where(F.col("classification") == 5).select("x", "y", "z").distinct()
    return joins.over_terrain(asked, model)


@query(f"WITH {B.POSITIVE}, edges AS (SELECT * FROM (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (1, 5), (5, 10), (12, 20), (20, 40)) t(low, high)) SELECT low, high, count(*) AS n FROM pos JOIN edges ON z >= low AND z < high GROUP BY ALL")
def q_uneven_bins(spark, d):
    edges = spark.createDataFrame([(0.0, 1.0), (1.0, 5.0), (5.0, 10.0), (12.0, 20.0), (20.0, 40.0)], "low double, high double")
    return joins.to_edges(B.positive(spark, d), edges).groupBy("low", "high").agg(F.count("*").alias("n"))


@query(B.final(_PROFILE, "", "height nrd", source="(SELECT bin * 2.0::DOUBLE AS height, round(nrd, 6) AS nrd FROM profile)"))
def q_parse_profile(spark, d):
    """The lines of a profile file, with its notes and a broken row, read back."""
    made = structure.profile(structure.height_bins(B.positive(spark, d))).select(F.concat_ws(",", (F.col("bin") * 2.0).cast("string"), F.format_string("%.6f", "nrd")).alias("value"))
    notes = B.positive(spark, d).agg(F.concat(F.lit("Threshold,"), F.lit(" of "), F.count("*").cast("string"), F.lit(" points")).alias("a"), F.lit("Height (m),NRD Value").alias("b"), F.lit("broken,row").alias("c"), F.lit("6.0").alias("e"))
    return rasters.parse_profile(made.unionByName(notes.select(F.explode(F.array("a", "b", "c", "e")).alias("value"))))


@query(f"WITH {B.COUNTS}, f AS (SELECT DISTINCT bin, CASE WHEN bin % 3 = 0 THEN 'a/layer_' || (bin + 1) || '.tif' WHEN bin % 3 = 1 THEN 'b/bin_' || bin * 2 || 'm.tif' ELSE 'c/pad_' || (bin + 1) || '.tif' END AS path FROM cb) SELECT path, bin AS layer FROM f WHERE bin < 8")
def q_raster_layers(spark, d):
    """The layers that raster files of height bins stand for, by three ways of naming."""
    b = F.col("bin")
    named = F.when(b % 3 == 0, F.concat(F.lit("a/layer_"), (b + 1).cast("string"), F.lit(".tif"))).when(b % 3 == 1, F.concat(F.lit("b/bin_"), (b * 2).cast("string"), F.lit("m.tif"))).otherwise(F.concat(F.lit("c/pad_"), (b + 1).cast("string"), F.lit(".tif")))
    return rasters.raster_files(structure.cell_bins(B.positive(spark, d)).select(named.alias("path")).distinct(), 2.0, 8)


@query(f"WITH {B.VEG} SELECT DISTINCT format('{{:.1f}}-{{:.1f}}m', floor(z / 2) * 2.0::DOUBLE, floor(z / 2) * 2.0::DOUBLE + 2) AS label, floor(z / 2) * 2.0::DOUBLE AS low FROM veg")
def q_label_low(spark, d):
    """Labels of all bins, those below zero too, and their lower edges."""
    labels = B.veg(spark, d).select(H.bin_label(F.floor(F.col("z") / 2)).alias("label")).distinct()
    return labels.select("label", H.label_low(F.col("label")).alias("low"))
