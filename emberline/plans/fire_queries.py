"""Queries on fire spread: single steps, runs, statistics, history and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import fire
from emberline.operators import fronts, simulate, spread, voxel
from emberline.plans import base as B
from emberline.scratch import new_path
from emberline.sources import points as P, store

QUERIES, ORACLE = {}, {}
_C = B.CONFIG.with_changes(stop_when_fire_extinguished=True)
_EMBERS = _C.with_changes(ember_probability=0.5)
_S = B.SIDE


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: B.rounded(f(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_START = B.STATIC + B.PATTERN


def _start(spark, d):
    return B.pattern(B.fuel(spark, d)).select("x", "y", "z", "state", "fuel")


@query(f"WITH {_START}, {B.MOVES} SELECT (x + dx)::BIGINT AS x, (y + dy)::BIGINT AS y, z::BIGINT AS z, count(*) AS n FROM s0, moves WHERE state = 1 GROUP BY ALL")
def q_neighbors_burning(spark, d):
    return spread.burning_neighbours(_start(spark, d))


@query(B.final(_START + ", " + B.MOVES + B.horizontal_sql("s0", "s1", 0), "x y z state", "fuel", source="s1"))
def q_step_horizontal(spark, d):
    return spread.horizontal(_start(spark, d), B.static(spark, d), 0, _C, _S, _S)


@query(f"WITH {_START}{B.vertical_lit_sql('s0', 'lit', 0)} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z FROM (SELECT DISTINCT x, y, z FROM lit)")
def q_step_vertical(spark, d):
    return spread.vertical_lit(_start(spark, d), B.static(spark, d), 0, _C, _S, _S).distinct()


_EMBER = _START + B.embers_sql("s0", "landed", 0, 0.5)


@query(f"WITH {_EMBER} SELECT sx::BIGINT AS sx, sy::BIGINT AS sy, sz::BIGINT AS sz, k::BIGINT AS k, tx::BIGINT AS tx, ty::BIGINT AS ty, tz::BIGINT AS tz, round(angle, 6) + 0.0::DOUBLE AS angle, distance::BIGINT AS distance, vertical::BIGINT AS vertical, round(p, 6) AS p, ignited FROM landed")
def q_step_ember(spark, d):
    landed = spread.embers(_start(spark, d), B.static(spark, d), 0, _EMBERS, _S, _S)
    return landed.select("sx", "sy", "sz", "k", "tx", "ty", "tz", "angle", "distance", "vertical", "p", "ignited")


@query(f"WITH {_EMBER} SELECT count(*) AS embers, count(*) FILTER (ignited) AS ignitions FROM landed")
def q_ember_counts(spark, d):
    landed = spread.embers(_start(spark, d), B.static(spark, d), 0, _EMBERS, _S, _S)
    return landed.agg(F.count("*").alias("embers"), F.count_if("ignited").alias("ignitions"))


_TIME = "greatest(1, floor(distance / 2)::INT)"


@query(f"WITH {_EMBER}, t AS (SELECT *, {_TIME} AS took FROM landed) SELECT 0::BIGINT AS step, sx::BIGINT AS source_x, sy::BIGINT AS source_y, sz::BIGINT AS source_z, tx::BIGINT AS target_x, ty::BIGINT AS target_y, tz::BIGINT AS target_z, round(angle, 6) + 0.0::DOUBLE AS angle, distance::BIGINT AS distance, vertical::BIGINT AS vertical_travel, round(p, 6) + 0.0::DOUBLE AS ignition_prob, ignited, round((tx - sx) / took::DOUBLE, 6) + 0.0::DOUBLE AS vx, round((ty - sy) / took::DOUBLE, 6) + 0.0::DOUBLE AS vy, round(vertical / took::DOUBLE, 6) + 0.0::DOUBLE AS vz, took::BIGINT AS travel_time, took::BIGINT AS remaining_steps FROM t")
def q_ember_records(spark, d):
    records = spread.ember_records(spread.embers(_start(spark, d), B.static(spark, d), 0, _EMBERS, _S, _S), 0)
    nested = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("source", "target") for c in "xyz"]
    return records.select("step", *nested, "angle", "distance", "vertical_travel", "ignition_prob", "ignited", "velocity.*", "travel_time", "remaining_steps")


def _spotting_sql() -> str:
    own, d, n = ("x", "y", "z"), lambda k: B.draw("'42'", "'0'", f"'{k}'", "x", "y", "z"), lambda k: B.normal_draw("'42'", "'0'", f"'{k}'", "x", "y", "z")
    thrown = f"thrown AS (SELECT {', '.join(own)} FROM s0 WHERE state = 1 AND fuel > 0.3 AND {d('so')} < (0.5::DOUBLE + 0.5::DOUBLE * z / 7.0::DOUBLE) * least(1.0::DOUBLE, fuel / 0.5::DOUBLE))"
    flown = f"flown AS (SELECT t.x, t.y, t.z, least(100.0::DOUBLE, exp(ln(100.0::DOUBLE / 3) + 0.7::DOUBLE * {n('sd').replace('x, y, z', 't.x, t.y, t.z')})) * (1.0::DOUBLE + 0.8::DOUBLE * speed / 10.0::DOUBLE) AS metres, dir + pi() / 8 * {n('sa').replace('x, y, z', 't.x, t.y, t.z')} AS bearing, floor({d('sz').replace('x, y, z', 't.x, t.y, t.z')} * 2)::INT AS fall FROM thrown t JOIN static USING (x, y, z))"
    landed = f"landed AS (SELECT x AS sx, y AS sy, z AS sz, metres, trunc(x + sin(bearing) * (metres / 5.0::DOUBLE))::INT AS tx, trunc(y + cos(bearing) * (metres / 5.0::DOUBLE))::INT AS ty, greatest(0, z - fall) AS tz, {d('si')} AS luck FROM flown)"
    hit = "hit AS (SELECT l.*, 0.4::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE * moisture) * least(1.0::DOUBLE, s.fuel / 0.3::DOUBLE) AS p FROM landed l JOIN s0 s ON s.x = tx AND s.y = ty AND s.z = tz AND s.state = 0 JOIN static m ON m.x = tx AND m.y = ty AND m.z = tz)"
    return f"WITH {_START}, {thrown}, {flown}, {landed}, {hit} SELECT sx::BIGINT AS sx, sy::BIGINT AS sy, sz::BIGINT AS sz, tx::BIGINT AS tx, ty::BIGINT AS ty, tz::BIGINT AS tz, round(metres, 6) + 0.0::DOUBLE AS metres, round(p, 6) + 0.0::DOUBLE AS p, luck < p AS ignited FROM hit"


@query(_spotting_sql())
def q_spotting(spark, d):
    return spread.spotting(_start(spark, d), B.static(spark, d), 0, _C, _S, _S, probability=1.0)


_STEPS = 3
_LIT = ", l0 AS (SELECT x, y, z, CASE WHEN abs(x - 20) <= 2 AND abs(y - 20) <= 2 AND z <= 1 THEN 1 ELSE 0 END AS state, fuel FROM fuel)"


def _run_sql() -> str:
    """The steps as WITH parts; each table is kept, so that it is not worked out again."""
    out = B.STATIC.replace("static AS (", "static AS MATERIALIZED (") + _LIT + ", " + B.MOVES
    for k in range(_STEPS):
        out += B.horizontal_sql(f"l{k}", f"h{k}", k).replace(f"h{k} AS (", f"h{k} AS MATERIALIZED (") + B.vertical_sql(f"h{k}", f"l{k + 1}", k).replace(f"l{k + 1} AS (", f"l{k + 1} AS MATERIALIZED (")
    return out


_RUN = _run_sql()
_SNAPS = _RUN + ", snaps AS (" + " UNION ALL ".join(f"SELECT {k} AS step, * FROM l{k}" for k in range(_STEPS + 1)) + ")"
_STATS = _SNAPS + ", stats AS (SELECT step, z, count(*) FILTER (state = 0) AS unburned, count(*) FILTER (state = 1) AS burning, count(*) FILTER (state = 2) AS burned FROM snaps GROUP BY ROLLUP (step, z) HAVING step IS NOT NULL)"


def _lit(spark, d):
    near = (F.abs(F.col("x") - 20) <= 2) & (F.abs(F.col("y") - 20) <= 2) & (F.col("z") <= 1)
    return B.fuel(spark, d).withColumn("state", F.when(near, 1).otherwise(0))


def _snaps(spark, d):
    from emberline.scratch import stage

    history: list = []
    simulate.run(_lit(spark, d), stage(B.static(spark, d), "static"), _C, _S, _S, _STEPS, history=history)
    return simulate.snapshots(history)


@query(B.final(_RUN, "x y z state", "fuel", source=f"l{_STEPS}"))
def q_sim_k(spark, d):
    return _snaps(spark, d).where(F.col("step") == _STEPS).select("x", "y", "z", "state", "fuel")


@query(f"WITH {_STATS} SELECT step::BIGINT AS step, coalesce(z, -1)::BIGINT AS z, unburned, burning, burned, unburned * 25.0::DOUBLE AS unburned_area, burning * 25.0::DOUBLE AS burning_area, burned * 25.0::DOUBLE AS burned_area FROM stats")
def q_sim_stats(spark, d):
    return simulate.statistics(_snaps(spark, d)).withColumn("z", F.coalesce("z", F.lit(-1)))  # -1: all layers


_WIDE = ", ".join(f"max(CASE WHEN z = {z} THEN {v} END)::BIGINT AS \"{z}_{v}\"" for z in range(B.LAYERS) for v in ("burning", "burned")) + ", " + ", ".join(f"round(max(CASE WHEN z = {z} THEN (burned + burning) / (burned + burning + unburned)::DOUBLE * 100 END), 6) + 0.0::DOUBLE AS \"{z}_percent\"" for z in range(B.LAYERS))


@query(f"WITH {_STATS} SELECT step::BIGINT AS step, max(burning) FILTER (z IS NULL) AS burning, max(burned) FILTER (z IS NULL) AS burned, max(unburned) FILTER (z IS NULL) AS unburned, round(max(CASE WHEN z IS NULL THEN (burning + burned) / (burning + burned + unburned)::DOUBLE * 100 END), 6) + 0.0::DOUBLE AS burned_percent, {_WIDE} FROM stats GROUP BY step")
def q_sim_stats_wide(spark, d):
    return simulate.wide_statistics(simulate.statistics(_snaps(spark, d)), B.LAYERS)


@query(f"WITH {_STATS} SELECT max_by(step, burning * 1000 - step)::BIGINT AS peak_step, max(burning) AS peak_burning FROM stats WHERE z IS NULL")
def q_peak(spark, d):
    return simulate.peak(simulate.statistics(_snaps(spark, d)))


_TOP = ", top AS (SELECT x, y, max(state) AS state FROM {t} GROUP BY x, y)"


@query(f"WITH {_RUN}{_TOP.format(t=f'l{_STEPS}')}, a AS (SELECT count(*) FILTER (state > 0) AS hit, count(*) AS n FROM top) SELECT hit * 25.0::DOUBLE AS burned_area, round(hit / n::DOUBLE * 100, 6) AS burned_percent, hit * 25.0::DOUBLE / 10000 AS hectares, CASE WHEN hit = 0 THEN 'none' WHEN hit / n::DOUBLE * 100 < 10 THEN 'limited' WHEN hit / n::DOUBLE * 100 < 30 THEN 'moderate' WHEN hit / n::DOUBLE * 100 < 60 THEN 'extensive' ELSE 'catastrophic' END AS pattern FROM a")
def q_burn_report(spark, d):
    return simulate.report(_snaps(spark, d).where(F.col("step") == _STEPS))


@query(f"WITH {_START}{_TOP.format(t='s0')} SELECT x::BIGINT AS x, y::BIGINT AS y, state::BIGINT AS state FROM top")
def q_composite(spark, d):
    return simulate.composite(_start(spark, d))


@query(f"WITH {_RUN} SELECT greatest(0, min(x) - 5)::BIGINT AS x_min, least(39, max(x) + 5)::BIGINT AS x_max, greatest(0, min(y) - 5)::BIGINT AS y_min, least(39, max(y) + 5)::BIGINT AS y_max FROM l{_STEPS} WHERE state > 0")
def q_bbox(spark, d):
    return simulate.bounding_box(_snaps(spark, d).where(F.col("step") == _STEPS), _S, _S)


@query(f"WITH {_SNAPS}, b AS (SELECT *, lag(state) OVER (PARTITION BY x, y, z ORDER BY step) AS before FROM snaps) SELECT step::BIGINT AS step, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, before::BIGINT AS before, state::BIGINT AS state FROM b WHERE before <> state")
def q_history_delta(spark, d):
    return simulate.changes(_snaps(spark, d))


@query(f"WITH {_RUN} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, state::BIGINT AS state FROM l2")
def q_state_at_step(spark, d):
    """A state from a stored history of keyframes and changes, of which one keyframe is read."""
    path = new_path(spark, "compressed")
    store.write_compressed(simulate.compress(_snaps(spark, d), 1), path, simulate.KEYFRAMES[1])
    return simulate.state_at(spark.read.parquet(path), P.grid(spark, _S, _S, B.LAYERS), 2)


@query(f"WITH {_START}, m AS (SELECT x, y, max((state > 0)::INT) AS s, max((state = 1)::INT) AS o FROM s0 WHERE z < 3 GROUP BY x, y), k AS (SELECT sum(s * o)::BIGINT AS hits, sum(s * (1 - o))::BIGINT AS false_alarms, sum((1 - s) * o)::BIGINT AS misses FROM m) SELECT *, round(hits / (hits + false_alarms + misses)::DOUBLE, 6) AS jaccard, round(2 * hits / (2 * hits + false_alarms + misses)::DOUBLE, 6) AS sorensen FROM k")
def q_overlay_metrics(spark, d):
    low = _start(spark, d).where("z < 3").groupBy("x", "y")
    made = low.agg(F.max(F.when(F.col("state") > 0, 1).otherwise(0)).alias("burned"))
    return simulate.overlay(made, low.agg(F.max(F.when(F.col("state") == 1, 1).otherwise(0)).alias("burned")))


@query(f"WITH {_START}, m AS (SELECT DISTINCT x, y FROM s0 WHERE state > 0 AND z = 0), e AS (SELECT count(*) AS edges FROM m, (VALUES (1,0),(-1,0),(0,1),(0,-1)) v(i, j) WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.x = m.x + i AND n.y = m.y + j)) SELECT edges, count(*) AS area, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y, round(edges / (4.0::DOUBLE * sqrt(count(*))), 6) AS shape FROM m, e GROUP BY edges")
def q_perimeter(spark, d):
    return simulate.perimeter(_start(spark, d).where("state > 0 AND z = 0").select("x", "y").distinct())


_BLOB = B.STATES + ", m AS (SELECT x, y FROM flat WHERE n % 3 > 0)"
#: unit edges of the mask, which lies on their left, and the edge after each
_EDGES = _BLOB + """, e AS (SELECT x + ax AS x, y + ay AS y, x + bx AS to_x, y + by_ AS to_y, side, (x + ax) * 1000 + (y + ay) * 10 + side AS id FROM m, (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) s(side, i, j, ax, ay, bx, by_) WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.x = m.x + i AND o.y = m.y + j)),
f AS (SELECT a.id, min_by(b.id, CASE (b.side - a.side + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS next FROM e a JOIN e b ON b.x = a.to_x AND b.y = a.to_y GROUP BY a.id),
walk AS (SELECT id AS start, id, 0 AS k FROM f UNION ALL SELECT start, next, k + 1 FROM walk JOIN f USING (id) WHERE next <> start),
whole AS (SELECT start, min(id) AS ring FROM walk GROUP BY start)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT e.x::BIGINT AS x, e.y::BIGINT AS y, r.x::BIGINT AS ring_x, r.y::BIGINT AS ring_y, r.side::BIGINT AS ring_side, k::BIGINT AS position FROM walk JOIN whole ON whole.start = walk.start AND whole.ring = walk.start JOIN e ON e.id = walk.id JOIN e r ON r.id = ring")
def q_perimeter_rings(spark, d):
    """The rings around the cells with some number of points, corner by corner."""
    found = fronts.rings(B.states(spark, d).where("n % 3 > 0"))
    return found.select("x", "y", F.col("ring.x").alias("ring_x"), F.col("ring.y").alias("ring_y"), F.col("ring.side").alias("ring_side"), "position")


def _front_sql(mask: str) -> str:
    return f"(SELECT x, y FROM {mask} a WHERE EXISTS (SELECT 1 FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(i, j) WHERE NOT EXISTS (SELECT 1 FROM {mask} b WHERE b.x = a.x + i AND b.y = a.y + j)))"


def _apart_sql(of: str, to: str) -> str:
    return f"(SELECT a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM {of} a, {to} b GROUP BY ALL)"


#: masks of a fire and of what was seen of it, at two times: what the run lit, and cells around that number of points let burn
_MASKS = _RUN + ", b1 AS (SELECT DISTINCT x, y FROM l1 WHERE state > 0), b3 AS (SELECT DISTINCT x, y FROM l3 WHERE state > 0), o1 AS (SELECT x, y FROM b1 WHERE (x + y) % 5 > 0 UNION SELECT x, y FROM cells WHERE x = 20 AND y BETWEEN 10 AND 30), o3 AS (SELECT x, y FROM b3 UNION SELECT x, y FROM cells WHERE x = 20 AND y BETWEEN 5 AND 35)"


def _masks(spark, d):
    from emberline.scratch import stage

    lit = stage(_snaps(spark, d).where("state > 0").select("step", "x", "y").distinct(), "lit")
    b1, b3 = (lit.where(F.col("step") == s).select("x", "y") for s in (1, 3))
    line = lambda low, high: B.cells(spark, d).where((F.col("x") == 20) & F.col("y").between(low, high))
    return b1, b3, b1.where((F.col("x") + F.col("y")) % 5 > 0).unionByName(line(10, 30)).distinct(), b3.unionByName(line(5, 35)).distinct()


@query(f"WITH {_MASKS}, p AS {_front_sql('b3')}, q AS {_front_sql('o3')}, both_ways AS (SELECT d FROM {_apart_sql('p', 'q')} UNION ALL SELECT d FROM {_apart_sql('q', 'p')}) SELECT round(avg(d) * 5, 6) AS mean_error, round(max(d) * 5, 6) AS hausdorff FROM both_ways")
def q_front_error(spark, d):
    """How far the front of the run is from one that was seen."""
    _, b3, _, o3 = _masks(spark, d)
    return fronts.front_error(b3, o3)


def _rate_sql(before: str, after: str) -> str:
    return f"(SELECT avg(d) * 5 / 10 AS rate FROM {_apart_sql(f'(SELECT * FROM {_front_sql(after)} ANTI JOIN {before} USING (x, y))', _front_sql(before))})"


@query(f"WITH {_MASKS}, s AS {_rate_sql('b1', 'b3')}, o AS {_rate_sql('o1', 'o3')} SELECT round(s.rate, 6) AS simulated, round(o.rate, 6) AS observed, round(s.rate - o.rate, 6) + 0.0::DOUBLE AS error, round((s.rate - o.rate) / o.rate, 6) + 0.0::DOUBLE AS relative_error FROM s, o")
def q_rate_error(spark, d):
    """The rate of spread of the run against that of what was seen, in metres a minute."""
    b1, b3, o1, o3 = _masks(spark, d)
    return fronts.rate_error((b1, b3), (o1, o3), 2)


_RUNS = B.POINTS + ", seen AS (SELECT classification % 4 AS run, floor(x / 5)::INT AS x, floor(y / 5)::INT AS y, count(*) AS n FROM points GROUP BY ALL), runs AS (SELECT run, s.range AS step, x, y, CASE WHEN n % 7 <= s.range THEN 1 ELSE 0 END AS state FROM seen, range(3) s)"


@query(f"WITH {_RUNS}, h AS (SELECT run, x, y, max((state > 0)::INT) AS hit, min(CASE WHEN state > 0 THEN step END) AS arrival FROM runs GROUP BY ALL) SELECT x::BIGINT AS x, y::BIGINT AS y, round(avg(hit), 6) AS burn_probability, coalesce(min(arrival), -1) AS first_arrival FROM h GROUP BY x, y")
def q_burn_probability(spark, d):
    seen = B.points(spark, d).groupBy((F.col("classification") % 4).alias("run"), P.cell("x").alias("x"), P.cell("y").alias("y")).agg(F.count("*").alias("n"))
    runs = seen.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return simulate.ensemble(runs.withColumn("state", F.when(F.col("n") % 7 <= F.col("step"), 1).otherwise(0))).na.fill(-1, ["first_arrival"])  # -1: never


def _chain(v: str, lit: str, k: int) -> tuple[str, str]:
    u = B.draw(repr("42"), repr("0"), repr("s"), "x", "y", repr(str(k)))
    return f"CASE WHEN coalesce(n, 0) >= {k} AND {u} < {v} THEN {v} * 0.8::DOUBLE ELSE {v} END", f"({lit} OR (coalesce(n, 0) >= {k} AND {u} < {v}))"


def _simple_sql() -> str:
    parts, v, lit = [], "vegetation", "false"
    body = B.STATES + ", f AS (SELECT x, y, state, (n * 5 % 10) / 10.0::DOUBLE AS vegetation FROM flat), n AS (SELECT x + i AS x, y + j AS y, count(*) AS n FROM f, (VALUES (0,-1),(0,1),(-1,0),(1,0)) m(i, j) WHERE state = 1 GROUP BY ALL), j AS (SELECT f.*, n, vegetation AS v0, false AS l0 FROM f LEFT JOIN n USING (x, y))"
    for k in range(1, 5):
        v, lit = _chain(f"v{k - 1}", f"l{k - 1}", k)
        parts.append(f"j{k} AS (SELECT *, {v} AS v{k}, {lit} AS l{k} FROM {'j' if k == 1 else f'j{k - 1}'})")
    inner = "x BETWEEN 1 AND 38 AND y BETWEEN 1 AND 38"
    out = f"({inner} AND state = 1 AND {B.draw(repr('42'), repr('0'), repr('o'), 'x', 'y')} < 0.1)"
    opened = f"({inner} AND state = 0 AND vegetation > 0.2)"
    return f"WITH {body}, {', '.join(parts)} SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN {out} THEN 2 WHEN {opened} AND l4 THEN 1 ELSE state END::BIGINT AS state, round(CASE WHEN {out} THEN 0 WHEN {opened} THEN v4 ELSE vegetation END, 6) AS vegetation FROM j4"


@query(_simple_sql())
def q_simple_step(spark, d):
    flat = B.states(spark, d).select("x", "y", "state", (F.col("n") * 5 % 10 / 10.0).alias("vegetation"))
    return spread.simple_step(flat, 0, _S, _S)


_LIT_BY = {"center": "x = 20 AND y = 20 AND z = 0", "corner": "x = 0 AND y = 0 AND z = 0", "coordinates": "(x, y, z) IN ((3, 4, 1), (30, 7, 0))"}


@query(f"WITH {B.FUEL} " + " UNION ALL ".join(f"SELECT '{m}' AS method, z::BIGINT AS z, count(*) FILTER ({on}) AS burning, round(sum(CASE WHEN {on} THEN fuel ELSE 0 END), 6) + 0.0::DOUBLE AS fuel FROM fuel GROUP BY z" for m, on in _LIT_BY.items()))
def q_ignition(spark, d):
    """The voxels of the forest that each way of ignition lights, by layer; a point off the grid lights none."""
    width, height = B.size(spark, d)
    voxels, out = B.fuel(spark, d), None
    for method in _LIT_BY:
        points = voxel.ignition_points(B.cells(spark, d), method, width, height, [(3, 4, 1), (30, 7, 0), (99, 4, 0)])
        lit = F.col("state") == 1
        rows = voxel.ignite(voxels, points).groupBy("z").agg(F.count_if(lit).alias("burning"), F.sum(F.when(lit, F.col("fuel")).otherwise(0.0)).alias("fuel")).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {B.CELLS} SELECT x::BIGINT AS x, y::BIGINT AS y, 0::BIGINT AS z FROM cells WHERE x IN (0, 39) OR y IN (0, 39) ORDER BY {B.draw(repr('42'), repr('rim'), 'x', 'y')}, x, y LIMIT 5")
def q_ignition_edge(spark, d):
    return voxel.ignition_points(B.cells(spark, d), "edge", *B.size(spark, d), k=5)


@query(f"WITH {B.FUEL}, p AS (SELECT floor({B.draw(repr('42'), repr('ix'), 'range')} * 40)::BIGINT AS x, floor({B.draw(repr('42'), repr('iy'), 'range')} * 40)::BIGINT AS y FROM range(6)) SELECT x, y, 0::BIGINT AS z, round(fuel, 6) + 0.0::DOUBLE AS fuel FROM fuel JOIN (SELECT DISTINCT x, y FROM p) USING (x, y) WHERE z = 0")
def q_ignition_random(spark, d):
    """The voxels that randomly drawn points light, and their fuel."""
    points = voxel.ignition_points(B.cells(spark, d), "random", *B.size(spark, d), k=6)
    return voxel.ignite(B.fuel(spark, d), points).where("state = 1").select("x", "y", "z", "fuel")


@query(f"WITH {B.STATES}, p AS (SELECT x // 4 AS tile_x, y // 4 AS tile_y, count(*) FILTER (state > 0) * 100 // count(*) AS percent FROM flat GROUP BY ALL) SELECT tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, percent, CASE WHEN percent <= 0 THEN 'none' WHEN percent < 10 THEN 'limited' WHEN percent < 30 THEN 'moderate' WHEN percent < 60 THEN 'extensive' ELSE 'catastrophic' END AS pattern, (percent * 5 // 60) || 'h ' || (percent * 5 % 60) || 'm' AS after FROM p")
def q_burn_pattern(spark, d):
    """How far the tiles of the forest burned, in words."""
    tile = [F.floor(F.col(c) / 4).alias(f"tile_{c}") for c in "xy"]
    share = B.states(spark, d).groupBy(*tile).agg(F.floor(F.count_if(F.col("state") > 0) * 100 / F.count("*")).cast("long").alias("percent"))
    return share.select("tile_x", "tile_y", "percent", fire.burn_pattern(F.col("percent")).alias("pattern"), fire.duration(F.col("percent")).alias("after"))
