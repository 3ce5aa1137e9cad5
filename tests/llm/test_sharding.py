import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.llm import sharding


def test_hypergeometric_has_the_right_law():
    rng, n = random.Random(4), 20_000
    draws = [sharding.hypergeometric(rng, 30, 100, 20) for _ in range(n)]
    assert sum(draws) / n == pytest.approx(6, abs=0.06)
    variance = 20 * 0.3 * 0.7 * 80 / 99
    assert sum((d - 6) ** 2 for d in draws) / n == pytest.approx(variance, rel=0.06)
    assert sharding.hypergeometric(rng, 0, 10, 5) == 0 and sharding.hypergeometric(rng, 10, 10, 5) == 5


def test_matrix_has_the_sums():
    rows, columns = [5, 0, 17, 900], [300, 311, 311]
    m = sharding.communication_matrix(random.Random(1), rows, columns)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m, strict=True)] == columns


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1003])
def test_exact_sizes_and_gapless_slots(spark, n):
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("é"), "id")).alias("text"), F.lit(9).alias("shard"), F.lit("x").alias("slot"))
    rows = sharding.shard_rows(d).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(x == list(range(len(x))) for x in slots.values())
    for r in rows:
        t = b"" if r.doc_id % 5 == 0 else f"é{r.doc_id}".encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)


def test_shuffle_is_uniform_and_repeats(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = sharding.shard_rows(d).collect()
    b = sharding.shard_rows(d.repartition(9)).collect()
    assert sorted(a) == sorted(b)
    low = sum(1 for r in a if r.doc_id < 2000 and r.shard == 0)
    assert abs(low - 250) < 50
    half = sum(1 for r in a if r.slot < 250 and r.doc_id < 2000)
    assert abs(half - 1000) < 110


def test_hot_repeated_rows_and_nulls(spark):
    rows = [(None, None)] * 300 + [(1, "a")] * 300 + [(i, "b") for i in range(300)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 900 and len({(r.shard, r.slot) for r in out}) == 900


def test_docs_keep_their_columns(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang")).write.parquet(str(tmp_path / "d"))
    out = sharding.shard_docs(spark.read.parquet(str(tmp_path / "d")))
    assert out.columns == ["doc_id", "text", "lang", "shard", "slot"] and out.count() == 50


def test_no_row_is_lost_when_files_are_packed_otherwise(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.create_map(F.lit("a"), "id").alias("m")).repartition(20).write.parquet(path)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        out = sharding.shard_docs(spark.read.parquet(path))
        spark.conf.set("spark.sql.files.minPartitionNum", "40")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        rows = out.collect()
        again = sharding.shard_docs(spark.read.parquet(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.doc_id for r in rows) == list(range(3000)) and len({(r.shard, r.slot) for r in rows}) == 3000
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


@pytest.mark.parametrize("copies", [65_536, 100])
def test_a_row_repeated_often(spark, monkeypatch, copies):
    monkeypatch.setattr(sharding, "COPIES", copies)
    monkeypatch.setattr(sharding, "PIECE_ROWS", 50)
    d = spark.range(900).select(F.when(F.col("id") < 400, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 400, None).otherwise(F.lit("t")).alias("text"))
    for out in (sharding.shard_rows(d), sharding.shard_docs(d)):
        rows = out.collect()
        assert sorted(r.doc_id for r in rows) == [1] * 400 + list(range(400, 900))
        slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
        assert all(x == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {112, 113}


def test_place_by_halving(spark):
    for shards in (1, 2, 3, 8, 13):
        out = sharding.shard_rows(spark.range(101).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), shards).groupBy("shard").count().collect()
        assert sorted(r["count"] for r in out) == sorted(sharding.split_evenly(101, shards))


def test_equals_the_rule_one_by_one(spark, monkeypatch):
    """Blocks, matrix, runs and slots in plain Python, from the keys of the copies."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 40)
    d = spark.range(700).select((F.col("id") % 600).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 600 % 9).alias("text"))
    seed, copies = 20_260, {}
    for r in d.collect():
        key = (r.doc_id, len(r.text) + 1, zlib.crc32(r.text.encode()))
        copies[key] = copies.get(key, 0) + 1
    units = spark.createDataFrame([(*k, n) for k, m in copies.items() for n in range(m)], "doc_id long, size long, text_crc32 long, _copy long")
    keys = units.select("*", *[F.xxhash64(F.lit(seed + i), "doc_id", "size", "text_crc32", "_copy").alias(f"k{i}") for i in range(3)]).collect()
    blocks = [[r for r in keys if r.k0 % sharding.MIN_BLOCKS == b] for b in range(sharding.MIN_BLOCKS)]
    matrix = sharding.communication_matrix(random.Random(seed), [len(b) for b in blocks], sharding.split_evenly(700, 8))
    high = lambda k: (k & (2**64 - 1)) >> 33

    def ranked(rows, key, n):
        pieces = max(1, -(-n // 40))
        return sorted(rows, key=lambda r: (high(r[key]) * pieces // 2**31, r[key]))

    shards = [[] for _ in range(8)]
    for rows, sent in zip(blocks, matrix, strict=True):
        rows, at = ranked(rows, "k1", max(map(len, blocks))), 0
        for s, n in enumerate(sent):
            shards[s] += rows[at : at + n]
            at += n
    expected = sorted((r.doc_id, r.size, r.text_crc32, s, slot) for s, rows in enumerate(shards) for slot, r in enumerate(ranked(rows, "k2", 88)))
    assert sorted(tuple(r) for r in sharding.shard_rows(d).collect()) == expected


def test_plan_is_native(spark):
    d = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    plan = sharding.shard_rows(d)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
