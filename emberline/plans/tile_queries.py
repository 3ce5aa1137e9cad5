"""Queries on tiles, regions, configuration, benchmarks and weather events."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import config as C
from emberline.functions import fire, keys
from emberline.operators import joins, raster, tiles
from emberline.plans import base as B
from emberline.sources import points as P
from emberline.streaming import live, wind as W

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: B.rounded(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _flat(spark, d):
    """Cells with a state that only the lower left of the forest has."""
    here = (F.col("x") < 12) & (F.col("y") < 25)
    return B.states(spark, d).select("x", "y", F.when(here, F.col("state")).otherwise(0).alias("state"))


_FLAT = B.STATES.replace("flat AS (", "all_cells AS (") + ", flat AS (SELECT x, y, CASE WHEN x < 12 AND y < 25 THEN state ELSE 0 END AS state FROM all_cells)"
#: tiles of 10 cells that overlap by 2
_GRID = ", grid AS (SELECT DISTINCT x // 8 AS tile_x, y // 8 AS tile_y FROM cells), tl AS (SELECT tile_x, tile_y, tile_x * 8 AS x_min, least(40, tile_x * 8 + 10) AS x_max, tile_y * 8 AS y_min, least(40, tile_y * 8 + 10) AS y_max FROM grid)"


def _tiles(spark, d):
    return tiles.tile_grid(spark, *B.size(spark, d), 10, 2)



@query(B.final(B.CELLS + _GRID, "tile_x tile_y x_min x_max y_min y_max", source="tl"))
def q_tiles(spark, d):
    return _tiles(spark, d)


@query(f"WITH {_FLAT}{_GRID} SELECT tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, count(*) AS cells, sum(state)::BIGINT AS states FROM flat JOIN tl ON x >= x_min AND x < x_max AND y >= y_min AND y < y_max GROUP BY ALL")
def q_tile_cells(spark, d):
    named = tiles.cells_of(_flat(spark, d), _tiles(spark, d), 8, 10)
    return named.groupBy("tile_x", "tile_y").agg(F.count("*").alias("cells"), F.sum("state").alias("states"))


@query(f"WITH {B.CELLS}, g AS (SELECT DISTINCT x // 10 AS tile_x, y // 10 AS tile_y FROM cells) SELECT g.tile_x::BIGINT AS tile_x, g.tile_y::BIGINT AS tile_y, h.tile_x::BIGINT AS near_x, h.tile_y::BIGINT AS near_y FROM g, g h WHERE abs(g.tile_x - h.tile_x) <= 1 AND abs(g.tile_y - h.tile_y) <= 1 AND (g.tile_x, g.tile_y) <> (h.tile_x, h.tile_y)")
def q_tile_neighbors(spark, d):
    return tiles.tile_neighbours(tiles.tile_grid(spark, *B.size(spark, d), 10))


_REGIONS = B.POINTS + ", r AS (SELECT l_suppkey AS region_id, floor(min(x) / 5)::INT - 5 AS x, floor(min(y) / 5)::INT - 5 AS y, floor((max(x) - min(x)) / 5)::INT AS w, floor((max(y) - min(y)) / 5)::INT AS h FROM (SELECT l_suppkey, (l_partkey % 40) * 5.0::DOUBLE + l_discount * 40.0::DOUBLE AS x, (l_orderkey % 40) * 5.0::DOUBLE + l_tax * 50.0::DOUBLE AS y FROM lineitem WHERE l_quantity > 48) GROUP BY l_suppkey)"


def _regions(spark, d):
    """(region_id, x, y, w, h): the cells around the tall points of each supplier, reaching over the rim."""
    tall = P.lineitem_points(spark, d, "l_suppkey", "l_quantity").where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("region_id"))
    at, wide = (lambda c: (F.floor(F.min(c) / 5) - 5).cast("int")), (lambda c: F.floor((F.max(c) - F.min(c)) / 5).cast("int"))
    return tall.agg(at("x").alias("x"), at("y").alias("y"), wide("x").alias("w"), wide("y").alias("h"))


@query(f"WITH {_REGIONS}, t AS (SELECT unnest(range(4)) AS k) SELECT region_id::BIGINT AS region_id, a.k AS tile_x, b.k AS tile_y FROM r, t a, t b WHERE a.k BETWEEN floor(x / 10) AND floor((x + w) / 10) AND b.k BETWEEN floor(y / 10) AND floor((y + h) / 10)")
def q_region_tiles(spark, d):
    return tiles.region_tiles(_regions(spark, d), 10, 4, 4)


_ACTS = _FLAT + ", acts AS (SELECT x // 10 AS tile_x, y // 10 AS tile_y, count(*) FILTER (state = 1) AS burning, bool_or(state > 0) AS touched FROM flat GROUP BY 1, 2)"


@query(f"WITH {_ACTS} SELECT tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, burning, touched, burning = 0 AND NOT EXISTS (SELECT 1 FROM acts b WHERE b.burning > 0 AND abs(a.tile_x - b.tile_x) + abs(a.tile_y - b.tile_y) = 1) AS can_rest FROM acts a")
def q_tile_activity(spark, d):
    return tiles.tile_activity(_flat(spark, d), 10)


@query(f"WITH {_ACTS} SELECT DISTINCT a.tile_x::BIGINT AS tile_x, a.tile_y::BIGINT AS tile_y FROM acts a JOIN acts b ON b.burning > 0 AND abs(a.tile_x - b.tile_x) <= 1 AND abs(a.tile_y - b.tile_y) <= 1 AND (a.tile_x, a.tile_y) <> (b.tile_x, b.tile_y) WHERE (a.tile_x, a.tile_y) NOT IN ((0, 0), (1, 1))")
def q_tile_activation(spark, d):
    active = spark.createDataFrame([(0, 0), (1, 1)], "tile_x int, tile_y int")
    return tiles.to_activate(active, _flat(spark, d), 10)


@query(f"WITH {B.POINTS}, t AS (SELECT floor(x / 40)::BIGINT AS tile_x, floor(y / 40)::BIGINT AS tile_y, count(*)::DOUBLE AS size, max(floor(z * 10))::BIGINT AS last_used FROM points GROUP BY ALL), r AS (SELECT *, sum(size) OVER (ORDER BY last_used DESC, tile_x, tile_y ROWS UNBOUNDED PRECEDING) AS running FROM t) SELECT *, running <= 20000 AS stays FROM r")
def q_lru(spark, d):
    """Which tiles stay within a budget of points, the highest first."""
    tile = [F.floor(F.col(c) / 40).alias(f"tile_{c}") for c in "xy"]
    held = B.points(spark, d).groupBy(*tile).agg(F.count("*").cast("double").alias("size"), F.max(F.floor(F.col("z") * 10)).alias("last_used"))
    return tiles.eviction(held, 20_000.0)


#: boxes of one cell for crowded cells and of five along x for empty ones, in rows 3 apart, so that boxes touch along x alone
_BARS = B.STATES + ", bars AS (SELECT x * 10 AS x_min, x * 10 + CASE state WHEN 1 THEN 45 ELSE 5 END AS x_max, y * 10 AS y_min, y * 10 + 5 AS y_max FROM flat WHERE state > 0 AND y % 3 = 0)"


@query(f"WITH {_BARS}, m AS (SELECT *, max(x_max) OVER (PARTITION BY y_min ORDER BY x_min ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bars), g AS (SELECT *, count(*) FILTER (before IS NULL OR x_min > before) OVER (PARTITION BY y_min ORDER BY x_min) AS run FROM m) SELECT min(x_min)::BIGINT AS x_min, max(x_max)::BIGINT AS x_max, y_min::BIGINT AS y_min, max(y_max)::BIGINT AS y_max FROM g GROUP BY y_min, run")
def q_merge_regions(spark, d):
    """Bars over the cells of a state, merged where they touch."""
    at = B.states(spark, d).where("state > 0 AND y % 3 = 0")
    long = F.when(F.col("state") == 1, 45).otherwise(5)
    bars = at.select((F.col("x") * 10).alias("x_min"), (F.col("x") * 10 + long).alias("x_max"), (F.col("y") * 10).alias("y_min"), (F.col("y") * 10 + 5).alias("y_max"))
    return tiles.merge_regions(bars)


_BOXES = "box AS (SELECT greatest(0, x - 3) AS x_min, least(39, x + 3) AS x_max, greatest(0, y - 3) AS y_min, least(39, y + 3) AS y_max, (x + y) % 3 AS asked FROM flat WHERE state = 1)"


@query(f"WITH {_FLAT}, {_BOXES}, f AS (SELECT x, y, coalesce((SELECT min(asked) FROM box WHERE f.x BETWEEN x_min AND x_max AND f.y BETWEEN y_min AND y_max), 3) AS level FROM flat f) SELECT f.x::BIGINT AS x, f.y::BIGINT AS y, level::BIGINT AS level, s.state::BIGINT AS state FROM f JOIN flat s ON s.x = f.x // (1 << level)::INT * (1 << level)::INT AND s.y = f.y // (1 << level)::INT * (1 << level)::INT")
def q_multi_resolution(spark, d):
    """A pyramid of four levels, read as fine as regions around burning cells ask."""
    flat = _flat(spark, d)
    lit = flat.where("state = 1")
    low, high = (lambda c: F.greatest(F.lit(0), F.col(c) - 3)), (lambda c: F.least(F.lit(39), F.col(c) + 3))
    boxes = lit.select(low("x").alias("x_min"), high("x").alias("x_max"), low("y").alias("y_min"), high("y").alias("y_max"), ((F.col("x") + F.col("y")) % 3).cast("int").alias("level"))
    return tiles.multi_resolution(raster.pyramid(flat, 4), boxes, flat)


_BOXES_OF = "r AS (SELECT l_suppkey AS box_id, min(x) / 5 AS x_min, max(x) / 5 AS x_max, min(y) / 5 AS y_min, max(y) / 5 AS y_max FROM (SELECT l_suppkey, (l_partkey % 40) * 5.0::DOUBLE + l_discount * 40.0::DOUBLE AS x, (l_orderkey % 40) * 5.0::DOUBLE + l_tax * 50.0::DOUBLE AS y FROM lineitem WHERE l_quantity > 49) GROUP BY l_suppkey)"


@query(f"WITH {B.CELLS}{_GRID}, {_BOXES_OF} SELECT box_id, tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y FROM r JOIN tl ON r.x_min < tl.x_max AND r.x_max > tl.x_min AND r.y_min < tl.y_max AND r.y_max > tl.y_min")
def q_raster_tiles(spark, d):
    """The tiles that the box around each supplier's tallest points touches."""
    tall = P.lineitem_points(spark, d, "l_suppkey", "l_quantity").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("box_id"))
    boxes = tall.agg(*[(f(c) / 5).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    return joins.overlapping(boxes, _tiles(spark, d))


@query(f"WITH {B.POINTS}, c AS (SELECT classification AS kind, ceil((max(x) - min(x)) * 100)::BIGINT AS width, ceil((max(y) - min(y)) * 100)::BIGINT AS height FROM points GROUP BY ALL), m AS (SELECT *, width * height * 8 AS total_cells, width * height * 8 * 15 / 1048576.0::DOUBLE AS total_mb, least(floor(sqrt(4000.0::DOUBLE * 1048576 / 15 / 8))::BIGINT, 200) AS side FROM c) SELECT kind::BIGINT AS kind, width, height, total_cells, round(total_mb, 6) AS total_mb, CASE WHEN total_mb > 4000 THEN ceil(width / greatest(1, side - 40))::BIGINT * ceil(height / greatest(1, side - 40))::BIGINT ELSE 0 END AS tiles FROM m")
def q_memory_plan(spark, d):
    """What a grid of centimetres over the points of each class would take."""
    wide = lambda c: F.ceil((F.max(c) - F.min(c)) * 100).alias(c)
    rows = []
    for kind, w, h in B.points(spark, d).groupBy("classification").agg(wide("x"), wide("y")).collect():  # a row for each class
        plan = C.memory_plan(C.Config(num_layers=8), w, h)
        rows.append((kind, w, h, plan["total_cells"], plan["total_mb"], plan.get("total_tiles", 0)))
    return spark.createDataFrame(rows, "kind long, width long, height long, total_cells long, total_mb double, tiles long")


#: parameters that the line numbers of orders stand for, and how wide their values range
_PARAMS = [("HORIZONTAL_SPREAD_PROBABILITY", 0.05), ("STORAGE_OPTIMIZATION_LEVEL", 0.1), ("MAX_STEPS", 400.0), ("MODEL_RESOLUTION", 1.0), ("MEMORY_LIMIT_MB", 5.0), ("WIND_INFLUENCE", 3.0), ("UNKNOWN", 1.0)]
_VALUES = ", ".join(f"({k + 1}, '{p}', {w!r}::DOUBLE)" for k, (p, w) in enumerate(_PARAMS))
_RULES = "(VALUES ('HORIZONTAL_SPREAD_PROBABILITY', 0.0, 1.0, 'FIX'), ('STORAGE_OPTIMIZATION_LEVEL', NULL, NULL, 'FIX'), ('MAX_STEPS', 1, 10000, 'WARNING'), ('MODEL_RESOLUTION', 0.1, 100, 'ERROR'), ('MEMORY_LIMIT_MB', 100, 1000000, 'FIX'), ('WIND_INFLUENCE', 0, 100, 'WARNING')) r(param, low, high, level)"


@query(f"WITH v AS (SELECT DISTINCT param, (l_quantity - 1) * w AS value FROM lineitem JOIN (VALUES {_VALUES}) p(k, param, w) ON k = l_linenumber), c AS (SELECT v.param, value, low, high, level, CASE WHEN low IS NULL THEN value NOT IN (0, 1, 2, 3) END AS outside FROM v JOIN {_RULES} ON r.param = v.param) SELECT param, round(value, 6) AS value, NOT coalesce(outside, value < low OR value > high) AS is_valid, CASE WHEN outside THEN 'not an allowed choice' WHEN value < low THEN 'below the lower bound' WHEN value > high THEN 'above the upper bound' ELSE 'ok' END AS message, CASE WHEN level <> 'FIX' THEN -1 WHEN outside THEN 0 WHEN value < low THEN low WHEN value > high THEN high ELSE -1 END::DOUBLE AS fixed_value, level FROM c")
def q_config_validate(spark, d):
    """Values that the orders give parameters, each checked by its rule and repaired (-1: nothing to repair)."""
    kinds = F.broadcast(spark.createDataFrame([(k + 1, p, w) for k, (p, w) in enumerate(_PARAMS)], "k int, param string, w double"))  # seven rows
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", "l_quantity").distinct()
    given = lines.join(kinds, F.col("l_linenumber") == F.col("k")).select("param", ((F.col("l_quantity") - 1) * F.col("w")).alias("value"))
    return C.validate(given, C.rules_table(spark)).na.fill(-1.0, ["fixed_value"])


@query("WITH c AS (SELECT DISTINCT l_orderkey % 97 AS config, (l_quantity * 4)::INT AS tile_size, l_discount * 15 AS spread_probability, l_tax AS max_fuel_value FROM lineitem) SELECT rule, count(*) AS configs FROM (SELECT unnest(['tile_configuration', 'spread_probability', 'max_fuel_value']) AS rule, unnest([tile_size > 40, spread_probability <= 1, max_fuel_value > 0.1]) AS ok FROM c) WHERE NOT ok GROUP BY rule")
def q_config_fields(spark, d):
    """How many of the configurations that orders stand for break each rule."""
    plain = {k: v for k, v in C.Config().to_dict().items() if not isinstance(v, tuple) and k not in ("tile_size", "spread_probability", "max_fuel_value")}
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 97).alias("config"), (F.col("l_quantity") * 4).cast("int").alias("tile_size"), (F.col("l_discount") * 15).alias("spread_probability"), F.col("l_tax").alias("max_fuel_value")).distinct()
    rows = lines.select("*", *[F.lit(v).alias(k) for k, v in plain.items()])
    return C.field_checks(rows).where(~F.col("ok")).groupBy("rule").agg(F.count("*").alias("configs"))


@query("WITH b AS (SELECT 'p' || (l_partkey % 50) AS param, count(*)::VARCHAR AS value FROM lineitem WHERE l_linenumber < 5 GROUP BY 1), c AS (SELECT 'p' || (l_suppkey % 80) AS param, 's' || count(*) AS value FROM lineitem WHERE l_linenumber > 5 AND l_suppkey % 3 = 0 GROUP BY 1) SELECT param, coalesce(c.value, b.value) AS value FROM b FULL JOIN c USING (param)")
def q_config_override(spark, d):
    """Parameters that parts set and that suppliers override."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    base = lines.where("l_linenumber < 5").groupBy(F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("param")).agg(F.count("*").cast("string").alias("value"))
    changes = lines.where("l_linenumber > 5 AND l_suppkey % 3 = 0").groupBy(F.concat(F.lit("p"), F.col("l_suppkey") % 80).alias("param")).agg(F.concat(F.lit("s"), F.count("*").cast("string")).alias("value"))
    return C.override(base, changes)


_AREAS = "areas AS (SELECT l_suppkey AS id, count(*) * 7000.0::DOUBLE AS area, (count(*) % 10) / 10.0::DOUBLE AS density, (sum(l_linenumber) % 13)::DOUBLE AS wind FROM lineitem GROUP BY 1), chosen AS (SELECT id, CASE WHEN area > 4000000 THEN 'large_area' WHEN wind > 7 THEN 'windy_conditions' WHEN density > 0.7 THEN 'high_resolution' ELSE 'default' END AS preset FROM areas)"


def areas(spark, d):
    """(id, area, density, wind): study areas that suppliers stand for."""
    n = F.count("*")
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("id")).agg((n * 7000.0).alias("area"), (n % 10 / 10.0).alias("density"), (F.sum("l_linenumber") % 13).cast("double").alias("wind"))


@query(f"WITH {_AREAS} SELECT preset, count(*) AS areas, CASE preset WHEN 'windy_conditions' THEN 10 ELSE 8 END::BIGINT AS params FROM chosen GROUP BY preset")
def q_presets(spark, d):
    """The presets that study areas choose, and how many parameters each sets."""
    chosen = areas(spark, d).select(C.preset_choice(F.col("area"), F.col("density"), F.col("wind")).alias("preset")).groupBy("preset").agg(F.count("*").alias("areas"))
    params = C.preset_table(spark).groupBy("preset").agg(F.count("*").alias("params"))
    return chosen.join(params, "preset")


_BENCH = "m AS (SELECT l_returnflag AS config, avg(l_quantity) AS seconds, avg(l_linenumber * 10.0::DOUBLE) AS mb FROM lineitem GROUP BY 1)"


@query(f"WITH {_BENCH} SELECT m.config, round(m.seconds, 6) AS seconds, round(m.mb, 6) AS mb, round(m.seconds / z.seconds * 100, 6) AS relative_seconds, round(m.mb / z.mb * 100, 6) AS relative_mb FROM m, m z WHERE z.config = 'N'")
def q_benchmark_relative(spark, d):
    """Means of the kinds of orders against those of one kind."""
    mean = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("config")).agg(F.avg("l_quantity").alias("seconds"), F.avg(F.col("l_linenumber") * 10.0).alias("mb"))
    zero = mean.where("config = 'N'").select(F.col("seconds").alias("s0"), F.col("mb").alias("m0"))  # one row
    return mean.join(F.broadcast(zero)).select("config", "seconds", "mb", (F.col("seconds") / F.col("s0") * 100).alias("relative_seconds"), (F.col("mb") / F.col("m0") * 100).alias("relative_mb"))


@query(f"WITH {B.STATES}, s AS (SELECT x, y, n % 12 * 5 AS slope, n % 13 * 9 AS ruggedness, n * 20 AS size FROM flat) SELECT x::BIGINT AS x, y::BIGINT AS y, slope, ruggedness, CASE WHEN slope > 35 OR ruggedness > 80 THEN 0 WHEN slope > 20 OR ruggedness > 50 THEN 1 WHEN slope > 10 OR ruggedness > 20 THEN 2 ELSE 3 END::BIGINT AS level, CASE WHEN size > 500 THEN ceil(5.0 * size / 500 * 2) / 2 ELSE 5.0 END::DOUBLE AS resolution FROM s")
def q_resolution_level(spark, d):
    n = F.col("n")
    return B.states(spark, d).select("x", "y", (n % 12 * 5).alias("slope"), (n % 13 * 9).alias("ruggedness"), fire.resolution_level(n % 12 * 5, n % 13 * 9).alias("level"), fire.coarser_resolution(F.lit(5.0), n * 20, F.lit(500)).alias("resolution"))


@query("SELECT strftime(time_bucket(INTERVAL 10 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS speed FROM events GROUP BY 1")
def q_event_wind(spark, d):
    found = W.windows(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "speed")


_LIVE = """e AS (SELECT user_id % 7 AS area, floor(epoch(ts))::BIGINT AS sec, event_type IN ('error', 'purchase') AS burns, user_id % 12 AS x, event_id % 12 AS y, value FROM events),
fire AS (SELECT area, x, y, min(sec) AS sec FROM e WHERE burns GROUP BY ALL), w AS (SELECT area, sec // 86400 * 86400 AS start, count(*) FILTER (NOT burns) AS n, avg(value) FILTER (NOT burns) AS speed FROM e GROUP BY 1, 2),
lit AS (SELECT w.area, start, x, y FROM w JOIN fire ON fire.area = w.area AND sec < start + 86400),
edges AS (SELECT area, start, count(*) AS shared FROM lit a JOIN lit b USING (area, start) WHERE abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2)"""


@query(f"WITH {_LIVE} SELECT w.area, start, n, round(coalesce(speed, -1), 6) AS speed, (SELECT count(*) FROM lit WHERE lit.area = w.area AND lit.start = w.start) AS cells, 4 * (SELECT count(*) FROM lit WHERE lit.area = w.area AND lit.start = w.start) - coalesce(shared, 0) AS perimeter FROM w LEFT JOIN edges USING (area, start)")
def q_live_windows(spark, d):
    """Daily wind, cells on fire and perimeter of the areas that events stand for (speed -1: no wind)."""
    burns = F.col("event_type").isin("error", "purchase")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 7).alias("area"), F.floor(F.col("ts").cast("timestamp").cast("double")).alias("at"), F.when(burns, "fire").otherwise("wind").alias("kind"),
        (F.col("user_id") % 12).cast("int").alias("x"), (F.col("event_id") % 12).cast("int").alias("y"), "value",
    )
    return live.windows(rows, 86_400).na.fill(-1.0, ["speed"])


@query(f"WITH {B.STATES} SELECT DISTINCT 'tile_' || (x // 8 - 2) || '_' || y // 8 || '_step_' || n % 4 AS key, (x // 8 - 2)::BIGINT AS x, (y // 8)::BIGINT AS y, n % 4 AS step FROM flat")
def q_tile_keys(spark, d):
    at = lambda c: F.floor(F.col(c) / 8)
    named = B.states(spark, d).select(keys.tile_key(at("x") - 2, at("y"), F.col("n") % 4).alias("key")).distinct()
    return named.select("key", keys.parse_key(F.col("key")).alias("k")).select("key", "k.*")


_RUNS = "r AS (SELECT l_linenumber AS config, l_quantity AS tiles, l_orderkey % 17 + 50.0::DOUBLE AS mb, l_partkey % 5 + 2.0::DOUBLE AS seconds, l_suppkey % 4 <> 3 AS ok FROM lineitem)"


@query(f"WITH {_RUNS} SELECT config::BIGINT AS config, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(avg(tiles), 6) AS mean_tiles, max(tiles) AS most_tiles, round(avg(mb), 6) AS mean_mb, max(mb) AS most_mb, round(64000 / avg(seconds), 6) AS cells_per_second FROM r GROUP BY config")
def q_run_metrics(spark, d):
    """Outcomes and means of the runs that orders stand for, by line number."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    runs = lines.select(F.col("l_linenumber").alias("config"), F.col("l_quantity").alias("tiles"), (F.col("l_orderkey") % 17 + F.lit(50.0)).alias("mb"), (F.col("l_partkey") % 5 + F.lit(2.0)).alias("seconds"), (F.col("l_suppkey") % 4 != 3).alias("ok"))
    facts = [F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.avg("tiles").alias("mean_tiles"), F.max("tiles").alias("most_tiles"), F.avg("mb").alias("mean_mb"), F.max("mb").alias("most_mb")]
    return runs.groupBy("config").agg(*facts, (F.lit(64000) / F.avg("seconds")).alias("cells_per_second"))
