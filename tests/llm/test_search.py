"""Ranked search against a plain version, with odd rows, and against its SQL."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import search
from emberline.llm.queries import ORACLE, QUERIES

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: TERM.findall((t or "").translate(SMALL))


def plain(docs, items, k=10):
    counts = [(d, Counter(words_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words_of(t))
    for item, words in asked.items():
        scores = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"docs": F.lit(1), "score": F.lit(2), "id": F.lit(3)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "df": F.lit(1), "weight": F.lit(1)})
    return sorted(map(tuple, search.search(search.build(d), q, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = [f"t{i}" for i in range(60)] + ["Été", "ÉTÉ", "Q", "q", "7"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([4, 30, 65])]) + rng.choice(["", ",", "_", "-"]) for _ in range(rng.randrange(n)))
    docs = [(i, text(80)) for i in range(300)] + [(None, "t1 t2"), (None, "t1 t2"), (500, None), (501, ""), (502, "..."), (503, "rare"), (7, "t1 t2"), (504, "t1 t2"), (505, "t1 t2"), (506, "t2 t1")]
    items = [(i, text(20)) for i in range(25)] + [(100, "t1 t2"), (101, None), (102, "nowhere"), (103, "rare"), (None, "t3"), (5, "t9 rare")]
    return docs, items


def test_equals_the_plain_version(spark, tables):
    assert found(spark, *tables) == plain(*tables)
    assert found(spark, *tables, k=3) == plain(*tables, 3)


def test_small_shards_blocks_and_pieces_change_nothing(spark, tables, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 100)
    monkeypatch.setattr(search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(search.terms, "PIECE", 30)
    assert found(spark, *tables) == plain(*tables)


def test_ties_rank_by_id(spark):
    docs = [(i, "same text here") for i in range(40, 0, -1)]
    assert found(spark, docs, [(1, "same")], 5) == plain(docs, [(1, "same")], 5)
    docs += [(100 + i, "other") for i in range(60)]
    got = found(spark, docs, [(1, "same")], 5)
    assert got == plain(docs, [(1, "same")], 5) and sorted(r[2] for r in got) == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a"), (2, "b")], []) == []


def test_best_takes_the_first_of_equals():
    scores = np.array([0, 5, 7, 5, 5, 9, 0, 5])
    assert sorted(search.best(scores, 4)) == [1, 2, 3, 5]
    assert sorted(search.best(np.array([0, 0, 3]), 2)) == [2]
    assert len(search.best(np.zeros(4, np.int64), 2)) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = QUERIES["op12_search"](spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE['op12_search']})").fetchall())
