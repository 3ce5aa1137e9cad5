"""The pipeline on planted cases, and its stages against the operators' own rules."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from emberline.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    text = lambda i, n=60: " ".join(f"w{(i * 31 + k * k * 7 + k * i) % 997}" for k in range(n))
    bench = [(i, text(600 + i, 30)) for i in range(5)]
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200 + i, text(i), "en", "s0", 1) for i in range(10)]
    rows += [(300 + i, text(i + 300) + " scum trash idiot scum loser", "en", "s1", 1) for i in range(40)]
    rows += [(400 + i, text(i + 500) + " " + bench[i][1] + " end", "en", "s2", 1) for i in range(5)]
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (502, " ".join(["long"] * 30_000), "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(300 + i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_act(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns[: len(columns)] == columns
    assert not set(range(300, 340)) & set(seen["toxicity"]) and set(range(120)) <= set(seen["toxicity"])
    near = set(seen["near_duplicates"])
    assert set(range(120)) <= near and not set(range(200, 210)) & near and len(near & {500, 501}) == 1
    clean = set(seen["decontamination"])
    assert not set(range(400, 405)) & clean and clean == near - set(range(400, 405))
    assert max(map(seen["mixing"].count, set(seen["mixing"]))) <= 3 and set(seen["mixing"]) <= clean
    assert sorted(seen["sharding"]) == sorted(seen["mixing"])
    slots = docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r.n == r.d == r.m + 1 for r in slots) and max(r.n for r in slots) - min(r.n for r in slots) <= 1


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []


def print_of(text, n):
    votes = [0] * 64
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    for h in hashes:
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(hashes))


def kept_by_brute_force(rows):
    """Smallest id of each component over all pairs: 4 bits by five or four words, or Jaccard 0.8 by five."""
    known = [(i, print_of(t, 5), print_of(t, 4), set(shingles(t, 5))) for i, t in rows]
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (_, f5, f4, s) in enumerate(known):
        for b, (_, g5, g4, t) in enumerate(known[:a]):
            near = (f5 ^ g5).bit_count() <= 4 or (f4 ^ g4).bit_count() <= 4 or bool(s and t and len(s & t) >= 0.8 * len(s | t))
            if near:
                root[find(a)] = find(b)
    least = {}
    for a, (i, *_) in enumerate(known):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted(least.values())


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 120))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.randrange(0, 4)):  # copies with some words changed: similarity on both sides of 0.8
            near = list(words)
            for _ in range(rng.randrange(0, max(2, len(near) // 25))):
                near[rng.randrange(len(near))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, "a b c d e"), (906, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == kept_by_brute_force(rows)


def test_leaks_equal_brute_force(spark, folder):
    from test_decontaminate import brute_tiling

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text.lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {r.doc_id for r in docs.collect() if r.doc_id == 502 or not any(brute_tiling((r.text or "").lower().split(), i, 5) / len(i) >= 0.6 for i in items)}
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, folder).collect()} == left


def test_run_equals_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "shard" in out.columns


def test_no_documents(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
