import random

import pytest
from pyspark.sql import functions as F

from emberline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    """Water filling over sources in code point order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_pivot_keeps_the_sum_and_rounds():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 30)
        words, chance = [rng.randrange(0, 50) for _ in range(n)], [rng.choice([0.0, 1.0, 0.3, rng.random()]) for _ in range(n)]
        rounded, at, p = mixing.pivot(words, chance, rng)
        total = sum(w * c for w, c in zip(words, chance, strict=True))
        got = sum(w * r for w, r in zip(words, rounded, strict=True)) + (words[at] * p if at >= 0 else 0)
        assert got == pytest.approx(total) and set(rounded) <= {0, 1}


def test_pivot_keeps_each_chance():
    hits, rng = [0] * 5, random.Random(7)
    words, chance = [3, 5, 8, 13, 4], [0.2, 0.7, 0.4, 0.5, 0.9]
    for _ in range(6000):
        rounded, at, p = mixing.pivot(words, chance, rng)
        if at >= 0:
            rounded[at] = int(rng.random() < p)
        hits = [h + r for h, r in zip(hits, rounded, strict=True)]
    assert [h / 6000 for h in hits] == pytest.approx(chance, abs=0.03)


def docs(spark, n=3000):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), (F.col("id") * 7 % 40 + 1).cast("int")), lambda i: F.concat(F.lit("w"), i)))
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).when(F.col("id") % 200 == 2, "rare").when(F.col("id") % 2 == 0, "é").otherwise("z")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 11, None).when(F.col("id") == 13, "").otherwise(words).alias("text"), source.alias("source"), F.lit("x").alias("copies"), F.lit(1).alias("unit"))


@pytest.mark.parametrize("chunk", [2048, 50])
def test_mix_meets_targets(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = mixing.mix(docs(spark)).collect()
    assert len(rows) == 3000
    sizes, taken, most = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        most[r.source] = max(most.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 3
    expected = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    for s, t in expected.items():
        assert abs(taken[s] - t) <= most[s] + 1e-6


def test_reruns_agree_whatever_the_partitions(spark):
    d = docs(spark, 800)
    show = lambda x: sorted((r.doc_id, r.copies) for r in mixing.mix(x).collect())
    assert show(d.repartition(7)) == show(d.coalesce(1).orderBy(F.desc("doc_id")))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b", None), (1, "a b", None), (1, "c", None), (2, None, "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(d)
    assert found.count() == 6
    assert found.groupBy("doc_id", "unit").agg(F.countDistinct("copies").alias("n")).where("n > 1").isEmpty()
    out = mixing.apply_mix(d)
    assert out.columns == d.columns and out.count() == found.agg(F.sum("copies")).first()[0]


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    only = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.copies for r in mixing.mix(only).collect()} == {0}


def test_a_source_comes_near_its_target_beside_a_very_long_document(spark):
    rng = random.Random(8)
    rows = [(i, "w " * (4_000 if i < 3 else rng.randrange(1, 300)), f"s{i % 3}") for i in range(150)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(0 <= r.copies <= 3 for r in out)
    for name in ("s0", "s1", "s2"):
        own = [r for r in out if r.source == name]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.01 * own[0].target


def test_what_is_left_is_made_up():
    assert mixing.made_up([10, 7, 5, 2, 1, 0], [1, 1, 0, 1, 0, 0], 8.0, 0) == [1]
    assert mixing.made_up([9, 6, 4, 3], [0, 1, 1, 0], -5.0, 0) == [3]
    assert mixing.made_up([10], [1], 3.0, 0) == []
