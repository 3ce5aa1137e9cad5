"""The stateful stream of wind and perimeters against its batch form, out of order, late and restarted."""

import random

from pyspark.sql import functions as F

from emberline.streaming import live

SIZE, DELAY = 600, 1800


def replay(rng, n):
    """Rows of two areas in the order of arrival: somewhat out of order, and some far too late."""
    rows = []
    for area in (1, 2):
        for t in sorted(rng.randrange(0, 30_000) for _ in range(n)):
            what = ("wind", None, None, float(rng.randrange(12))) if rng.random() < 0.5 else ("fire", rng.randrange(7), rng.randrange(7), None)
            rows.append((area, t, *what))
    rows.sort(key=lambda r: r[1] + rng.randrange(0, DELAY // 2))
    for _ in range(6):
        rows.insert(rng.randrange(len(rows) // 2, len(rows)), (rng.choice((1, 2)), rng.randrange(0, 3_000), "wind", None, None, 99.0))
    return rows


def late_ones(rows):
    latest, late = {}, []
    closed = {}
    seen = {}
    for r in rows:
        area, at = r[:2]
        start = at // SIZE * SIZE
        if start < closed.get(area, -1):
            late.append(r)
            continue
        seen.setdefault(area, set()).add(start)
        latest[area] = max(at, latest.get(area, at))
        done = {s for s in seen[area] if s + SIZE + DELAY <= latest[area]}
        if done:
            closed[area] = max(closed.get(area, 0), max(done) + SIZE)
    return late, latest


def test_a_replay_with_restarts_equals_the_batch(spark, tmp_path):
    rows = replay(random.Random(3), 90)
    late, latest = late_ones(rows)
    assert late
    schema = spark.createDataFrame([], live.ROWS).schema
    watch, cut = live.Progress(), len(rows) // 5 + 1
    spark.streams.addListener(watch)
    try:
        for k in range(5):  # a start for each part, each from the checkpoint of the one before
            spark.createDataFrame(rows[k * cut : (k + 1) * cut], live.ROWS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            query = live.follow(stream, SIZE, DELAY).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
            query.format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(watch)
    found = spark.read.parquet(str(tmp_path / "out"))
    told = {(r.area, r.start, r.speed) for r in found.where("kind = 'late'").collect()}
    assert told == {(r[0], r[1], r[5]) for r in late}
    sound = spark.createDataFrame([r for r in rows if r not in late], live.ROWS)
    closed = F.when(F.col("area") == 1, latest[1]).otherwise(latest[2])
    expected = live.windows(sound, SIZE).where(F.col("start") + SIZE + DELAY <= closed)
    columns = ["area", "start", "n", "speed", "cells", "perimeter"]
    rounded = lambda df: sorted((r.area, r.start, r.n, None if r.speed is None else round(r.speed, 9), r.cells, r.perimeter) for r in df.select(columns).collect())
    assert rounded(found.where("kind = 'window'")) == rounded(expected)
    assert watch.rows >= len(rows) and watch.batches >= 5 and watch.error is None


def test_a_listener_keeps_the_error_of_a_stream(spark, tmp_path):
    watch = live.Progress()
    spark.streams.addListener(watch)
    try:
        bad = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.raise_error(F.lit("gone wrong")).cast("string").alias("x"))
        query = bad.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.awaitTermination(30)
        except Exception:
            pass
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        assert watch.ended and "gone wrong" in watch.error
    finally:
        spark.streams.removeListener(watch)


def test_batch_windows_of_a_small_fire(spark):
    rows = [(1, 10, "fire", 0, 0, None), (1, 700, "fire", 1, 0, None), (1, 650, "wind", None, None, 4.0), (1, 20, "fire", 1, 0, None), (1, 1300, "fire", 5, 5, None)]
    got = sorted(tuple(r) for r in live.windows(spark.createDataFrame(rows, live.ROWS)).select("start", "n", "speed", "cells", "perimeter").collect())
    assert got == [(0, 0, None, 2, 6), (600, 1, 4.0, 2, 6), (1200, 0, None, 3, 10)]
