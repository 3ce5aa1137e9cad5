"""What the queries share: the test tables as model inputs, and result formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.config import Config
from emberline.operators import filters, structure, terrain, voxel
from emberline.sources import points as P

SIDE, LAYERS = 40, 8
CONFIG = Config(num_layers=LAYERS, canopy_start_layer=LAYERS // 2)


def rounded(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, fractions as DOUBLE with six decimals and without a negative zero."""
    kinds = dict(df.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    pick = lambda c: F.col(c).cast("bigint") if kinds[c] in whole else (F.round(F.col(c), 6) + F.lit(0.0) if kinds[c] == "double" else F.col(c))
    return df.select(*[pick(c).alias(c) for c in df.columns])


def points(spark: SparkSession, d: str) -> DataFrame:
    return P.lineitem_points(spark, d)


def veg(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_classes(points(spark, d), (3, 4, 5))


def positive(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_negative(veg(spark, d))


def pad(spark: SparkSession, d: str) -> DataFrame:
    return structure.cell_pad(positive(spark, d))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(x, y): the frame that the points span, in cells of 5 m."""
    top = points(spark, d).agg(F.max(P.cell("x")).alias("w"), F.max(P.cell("y")).alias("h"))  # one row
    return top.select(F.explode(F.sequence(F.lit(0), "w")).alias("x"), "h").select("x", F.explode(F.sequence(F.lit(0), "h")).alias("y"))


def size(spark: SparkSession, d: str) -> tuple[int, int]:
    """Width and height of the frame."""
    return tuple(points(spark, d).agg(F.max(P.cell("x")) + 1, F.max(P.cell("y")) + 1).first())


def ground(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, elev): the lowest ground point of each cell that has one."""
    return points(spark, d).where("classification = 2").groupBy(P.cell("x").alias("x"), P.cell("y").alias("y")).agg(F.min("z").alias("elev"))


def surface(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, elev) of all cells, 0 where there is no ground point."""
    return cells(spark, d).join(ground(spark, d), ["x", "y"], "left").na.fill(0.0, ["elev"])


def states(spark: SparkSession, d: str) -> DataFrame:
    """(x, y, n, state): the number of points of each cell, and a state that it stands for."""
    n = points(spark, d).groupBy(P.cell("x").alias("x"), P.cell("y").alias("y")).agg(F.count("*").alias("n"))
    known = cells(spark, d).join(n, ["x", "y"], "left").na.fill(0, ["n"])
    return known.withColumn("state", F.when(F.col("n") % 5 == 1, 1).when(F.col("n") % 5 == 2, 2).otherwise(0))


def wind(spark: SparkSession, d: str) -> DataFrame:
    return terrain.terrain_wind(surface(spark, d))


def moisture(spark: SparkSession, d: str) -> DataFrame:
    tax = points(spark, d).groupBy(P.cell("x").alias("x"), P.cell("y").alias("y")).agg(F.avg("tax").alias("value"))
    return voxel.moisture_field(cells(spark, d), tax)


def fuel(spark: SparkSession, d: str) -> DataFrame:
    return voxel.fuel_grid(P.grid(spark, SIDE, SIDE, LAYERS), pad(spark, d))


def static(spark: SparkSession, d: str) -> DataFrame:
    flat = moisture(spark, d).join(wind(spark, d).select("x", "y", "dir", "speed", "u", "v"), ["x", "y"])
    return voxel.with_connectivity(fuel(spark, d)).select("x", "y", "z", "conn_up").join(flat, ["x", "y"])


def pattern(cells: DataFrame) -> DataFrame:
    """A fixed pattern of burning and burned voxels, for one-step queries."""
    k = (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 3) % 17
    return cells.withColumn("state", F.when(k == 0, 1).when(k == 1, 2).otherwise(0))


# SQL twins of the inputs above; they are parts of WITH clauses.
POINTS = "points AS (SELECT (l_partkey % 40) * 5.0::DOUBLE + l_discount * 40.0::DOUBLE AS x, (l_orderkey % 40) * 5.0::DOUBLE + l_tax * 50.0::DOUBLE AS y, l_quantity * 0.6::DOUBLE - 2.0::DOUBLE AS z, l_linenumber AS classification, l_tax AS tax FROM lineitem)"
VEG = POINTS + ", veg AS (SELECT * FROM points WHERE classification IN (3, 4, 5))"
POSITIVE = VEG + ", pos AS (SELECT * FROM veg WHERE z >= 0)"
COUNTS = POSITIVE + ", cb AS (SELECT floor(x / 5)::INT AS gx, floor(y / 5)::INT AS gy, floor(z / 2)::BIGINT AS bin, count(*) AS n FROM pos GROUP BY ALL)"
PAD_OF = "CASE WHEN nrd <= 0 THEN 0.0::DOUBLE ELSE greatest(0.1::DOUBLE, least(10.0::DOUBLE, -ln(1.0::DOUBLE - least(nrd, 0.9999::DOUBLE)) / 1.2::DOUBLE)) END"
PAD = COUNTS + f", dens AS (SELECT *, n / (sum(n) OVER (PARTITION BY gx, gy ORDER BY bin ROWS UNBOUNDED PRECEDING))::DOUBLE AS nrd FROM cb), pad AS (SELECT *, {PAD_OF} AS pad FROM dens)"
FRAME = ", xs AS (SELECT unnest(range((max(floor(x / 5)) + 1)::BIGINT))::INT AS x FROM points), ys AS (SELECT unnest(range((max(floor(y / 5)) + 1)::BIGINT))::INT AS y FROM points), cells AS (SELECT x, y FROM xs, ys)"
CELLS = POINTS + FRAME
SURFACE = FRAME + ", lowest AS (SELECT floor(x / 5)::INT AS x, floor(y / 5)::INT AS y, min(z) AS elev FROM points WHERE classification = 2 GROUP BY ALL), surface AS (SELECT x, y, coalesce(elev, 0.0::DOUBLE) AS elev FROM cells LEFT JOIN lowest USING (x, y))"
STATES = CELLS + ", flat AS (SELECT x, y, coalesce(n, 0) AS n, CASE coalesce(n, 0) % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS state FROM cells LEFT JOIN (SELECT floor(x / 5)::INT AS x, floor(y / 5)::INT AS y, count(*) AS n FROM points GROUP BY ALL) USING (x, y))"
BESIDE = SURFACE + ", beside AS (SELECT *, lag(elev) OVER wx AS x0, lead(elev) OVER wx AS x1, lag(elev) OVER wy AS y0, lead(elev) OVER wy AS y1 FROM surface WINDOW wx AS (PARTITION BY y ORDER BY x), wy AS (PARTITION BY x ORDER BY y))"
GRADIENT = BESIDE + ", slopes AS (SELECT *, coalesce((x1 - x0) / 2, x1 - elev, elev - x0) AS dx, coalesce((y1 - y0) / 2, y1 - elev, elev - y0) AS dy FROM beside), g AS (SELECT *, sqrt(dx * dx + dy * dy) AS slope, atan2(dy, dx) AS aspect, coalesce(x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL AND least(x0, x1, y0, y1) - elev < -{t} AND greatest(x0, x1, y0, y1) - elev > {t}, false) AS ravine FROM slopes)"
_TURN = "(2 * pi())"
WIND_TAIL = f""", w1 AS (SELECT *, (abs(0.0::DOUBLE - aspect) - floor(abs(0.0::DOUBLE - aspect) / {_TURN}) * {_TURN}) AS raw FROM g),
w2 AS (SELECT *, sin(CASE WHEN raw > pi() THEN {_TURN} - raw ELSE raw END) * 0.5::DOUBLE AS share FROM w1),
w3 AS (SELECT *, (1.0::DOUBLE - share) * 0.0::DOUBLE + share * aspect AS bent FROM w2),
w4 AS (SELECT *, CASE WHEN slope >= 0.05 THEN bent - floor(bent / {_TURN}) * {_TURN} ELSE 0.0::DOUBLE END AS dir FROM w3),
w5 AS (SELECT *, CASE WHEN slope >= 0.05 THEN 0.5::DOUBLE * greatest(0.5::DOUBLE, least(1.5::DOUBLE, 1.0::DOUBLE - cos(dir - aspect) * slope * 0.5::DOUBLE)) * CASE WHEN ravine THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.5::DOUBLE END AS speed FROM w4),
wind AS (SELECT x, y, elev, slope, aspect, ravine, dir, speed, speed * cos(dir) AS u, speed * sin(dir) AS v FROM w5)"""
WIND_PARTS = GRADIENT.format(t="5.0::DOUBLE") + WIND_TAIL
WIND = POINTS + WIND_PARTS
FUEL = PAD + ", vox AS (SELECT a.range::INT AS x, b.range::INT AS y, c.range::INT AS z FROM range(40) a, range(40) b, range(8) c), fuel AS (SELECT vox.*, coalesce(pad.pad / 10.0::DOUBLE, 0.0::DOUBLE) AS fuel FROM vox LEFT JOIN pad ON gx = vox.x AND gy = vox.y AND bin = vox.z)"
MOISTURE = ", tax AS (SELECT floor(x / 5)::INT AS x, floor(y / 5)::INT AS y, avg(tax) AS value FROM points GROUP BY ALL), moist AS (SELECT cells.x, cells.y, coalesce(CASE WHEN hi > lo THEN 0.1::DOUBLE + (value - lo) / (hi - lo) * 0.8::DOUBLE ELSE 0.3::DOUBLE END, 0.3::DOUBLE) AS moisture FROM cells LEFT JOIN tax USING (x, y), (SELECT min(value) AS lo, max(value) AS hi FROM tax))"
_CONN = "0.1::DOUBLE + 0.8::DOUBLE * (0.4::DOUBLE * least(a, b) / 10 + 0.4::DOUBLE * (1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, abs(a - b) / greatest(a + b, 1e-6::DOUBLE)))) + 0.2::DOUBLE * (1 - abs(exp(-1.0::DOUBLE * a) - exp(-1.0::DOUBLE * b))))"
CONN = f", two AS (SELECT *, fuel * 10 AS a, (lead(fuel) OVER (PARTITION BY x, y ORDER BY z)) * 10 AS b FROM fuel), conn AS (SELECT x, y, z, fuel, CASE WHEN b IS NOT NULL THEN {_CONN} END AS conn_up FROM two)"
STATIC = FUEL + WIND_PARTS + MOISTURE + CONN + ", static AS (SELECT conn.x, conn.y, conn.z, conn_up, moisture, dir, speed, u, v FROM conn JOIN moist USING (x, y) JOIN wind USING (x, y))"
PATTERN = ", s0 AS (SELECT x, y, z, CASE (x * 7 + y * 13 + z * 3) % 17 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS state, fuel FROM fuel)"


def draw(*key: str) -> str:
    """SQL twin of functions.rng.uniform."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def normal_draw(*key: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(greatest({draw(*key, repr('a'))}, 1e-12::DOUBLE))) * cos(2 * pi() * {draw(*key, repr('b'))}))"


MOVES = "moves AS (SELECT * FROM (VALUES (0,-1),(0,1),(-1,0),(1,0),(-1,-1),(1,-1),(-1,1),(1,1)) t(dx, dy))"


def horizontal_sql(before: str, after: str, step: int) -> str:
    """WITH parts of one horizontal step from table `before` to table `after`."""
    p = f"{after}_"
    return f""", {p}n AS (SELECT b.x + dx AS x, b.y + dy AS y, b.z, count(*) AS n FROM {before} b, moves WHERE b.state = 1 GROUP BY ALL),
{p}b AS (SELECT *, fuel - 0.2::DOUBLE * (1.0::DOUBLE - 0.5::DOUBLE * z / 8) AS rest FROM {before} WHERE state = 1 AND x BETWEEN 1 AND 38 AND y BETWEEN 1 AND 38),
{p}t AS (SELECT t.x, t.y, t.z, t.fuel, dx, dy, st.u, st.v, b.x AS sx, b.y AS sy FROM {p}b b JOIN static st ON st.x = b.x AND st.y = b.y AND st.z = b.z, moves, {before} t WHERE b.rest > 0 AND t.x = b.x + dx AND t.y = b.y + dy AND t.z = b.z AND t.state = 0 AND t.fuel > 0),
{p}p AS (SELECT t.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + exp(-1.5::DOUBLE * (n - 1.0::DOUBLE))) * t.fuel * (1.0::DOUBLE + greatest(0.0::DOUBLE, (t.u * dx - t.v * dy) / sqrt((dx * dx + dy * dy)::DOUBLE))) * (1.0::DOUBLE - moisture) * CASE WHEN abs(dx) + abs(dy) > 1 THEN 0.707::DOUBLE ELSE 1.0::DOUBLE END)) AS p FROM {p}t t JOIN static st USING (x, y, z) JOIN {p}n USING (x, y, z)),
{p}l AS (SELECT DISTINCT x, y, z FROM {p}p WHERE p > 0.01 AND {draw("'42'", repr(str(step)), "'h'", "sx", "sy", "z", "x", "y", "z")} < p),
{after} AS (SELECT s.x, s.y, s.z, CASE WHEN b.x IS NOT NULL THEN CASE WHEN b.rest <= 0 THEN 2 ELSE 1 END WHEN l.x IS NOT NULL THEN 1 ELSE s.state END AS state, CASE WHEN b.x IS NOT NULL THEN greatest(0.0::DOUBLE, b.rest) ELSE s.fuel END AS fuel FROM {before} s LEFT JOIN {p}b b ON b.x = s.x AND b.y = s.y AND b.z = s.z LEFT JOIN {p}l l ON l.x = s.x AND l.y = s.y AND l.z = s.z)"""


def vertical_lit_sql(before: str, name: str, step: int) -> str:
    """WITH parts of the voxels lit from above or below, as table `name`."""
    u = draw("'42'", repr(str(step)), "'v'", "b.x", "b.y", "b.z", "t.x", "t.y", "t.z")
    up = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, st.conn_up * (1.0::DOUBLE - m.moisture) * t.fuel * CASE WHEN b.z >= 4 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END))"
    return f""", {name} AS (SELECT t.x, t.y, t.z FROM {before} b JOIN static st ON st.x = b.x AND st.y = b.y AND st.z = b.z, (VALUES (1), (-1)) d(dz), {before} t JOIN static m ON m.x = t.x AND m.y = t.y AND m.z = t.z
WHERE b.state = 1 AND b.x BETWEEN 1 AND 38 AND b.y BETWEEN 1 AND 38 AND t.x = b.x AND t.y = b.y AND t.z = b.z + dz AND t.state = 0 AND t.fuel > 0 AND {u} < CASE WHEN dz = 1 THEN {up} ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE * t.fuel)) END)"""


def embers_sql(before: str, name: str, step: int, rate: float = 0.02) -> str:
    """WITH parts of landed embers, as table `name`."""
    own, s = ("x", "y", "z"), repr(str(step))
    p = f"{name}_"
    normal = normal_draw("'42'", s, "'ed'", *own, "k", "'angle'")
    return f""", {p}a AS (SELECT b.x, b.y, b.z, dir, speed, unnest(range(1, 2 + floor({draw("'42'", s, "'en'", "b.x", "b.y", "b.z")} * 3)::INT)) AS k FROM {before} b JOIN static st ON st.x = b.x AND st.y = b.y AND st.z = b.z WHERE state = 1 AND b.x BETWEEN 1 AND 38 AND b.y BETWEEN 1 AND 38 AND {draw("'42'", s, "'e'", "b.x", "b.y", "b.z")} < {rate}),
{p}b AS (SELECT *, dir + pi() / 4 * greatest(0.0::DOUBLE, 1.0::DOUBLE - speed) * {normal} AS angle FROM {p}a),
{p}c AS (SELECT *, greatest(1, least(10, trunc(5.0::DOUBLE * (1.0::DOUBLE + speed * cos(angle - dir)))::INT + 1)) AS distance, CASE WHEN least(3, z) > 0 THEN -(1 + floor({draw("'42'", s, "'ed'", *own, "k", "'fall'")} * least(3, z))::INT) ELSE 0 END AS vertical FROM {p}b),
{p}d AS (SELECT *, trunc(x + distance * cos(angle))::INT AS tx, trunc(y + distance * sin(angle))::INT AS ty, z + vertical AS tz FROM {p}c),
{p}e AS (SELECT d.*, t.fuel, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * greatest(0.3::DOUBLE, 1.0::DOUBLE - distance / 5.0::DOUBLE) * greatest(0.3::DOUBLE, 1.0::DOUBLE - vertical * 0.2::DOUBLE) * (1.0::DOUBLE + t.fuel * 0.5::DOUBLE))) AS p FROM {p}d d JOIN {before} t ON t.x = tx AND t.y = ty AND t.z = tz WHERE tx BETWEEN 0 AND 39 AND ty BETWEEN 0 AND 39 AND t.state = 0 AND t.fuel > 0),
{name} AS (SELECT x AS sx, y AS sy, z AS sz, k, tx, ty, tz, angle, distance, vertical, p, {draw("'42'", s, "'ei'", *own, "k")} < p AS ignited FROM {p}e)"""


def vertical_sql(before: str, after: str, step: int, rate: float = 0.02) -> str:
    v, e = f"{after}_v", f"{after}_e"
    return vertical_lit_sql(before, v, step) + embers_sql(before, e, step, rate) + f""", {after} AS (SELECT s.x, s.y, s.z, CASE WHEN l.x IS NOT NULL THEN 1 ELSE s.state END AS state, s.fuel FROM {before} s LEFT JOIN (SELECT x, y, z FROM {v} UNION SELECT tx, ty, tz FROM {e} WHERE ignited) l ON l.x = s.x AND l.y = s.y AND l.z = s.z)"""


def final(body: str, whole: str = "", real: str = "", other: str = "", source: str = "") -> str:
    """SELECT over the WITH clause in the format of rounded()."""
    parts = [f"({c})::BIGINT AS {c}" for c in whole.split()] + [f"round(({c})::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in real.split()] + other.split()
    return f"WITH {body} SELECT {', '.join(parts)} FROM {source}"


