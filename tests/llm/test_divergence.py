"""The divergence audit against a plain version, with odd rows, and against its SQL."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.llm import divergence
from emberline.llm.queries import ORACLE, QUERIES

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """rows (text, lang, source)."""
    langs = defaultdict(list)
    for text, lang, source in rows:
        langs[lang or ""].append((source or "", TERM.findall((text or "").translate(SMALL))))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, words in docs for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = defaultdict(Counter)
        for source, words in docs:
            counts[source].update(w for w in words if df[w] >= 3)
        whole = sum(counts.values(), Counter())
        share = lambda c, t, n: 1 + 10**9 * (c[t] + 1) // (n + len(kept))
        sizes = {s: sum(c.values()) for s, c in counts.items()}
        for s, c in counts.items():
            pairs = []
            for o in counts:
                if o != s:
                    ps = [(share(c, t, sizes[s]), share(counts[o], t, sizes[o])) for t in kept]
                    pairs.append((-sum((p - q) ** 2 // q for p, q in ps), o.encode()))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))]
            found = []
            for t in kept:
                p, q = share(c, t, sizes[s]), share(whole, t, sum(sizes.values()))
                if c[t] and p > q:
                    found.append((-((p - q) ** 2 // q), t.encode()))
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("x"), "idx": F.lit(2)})
    return sorted(map(tuple, divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Äpfel", "ÉTÉ", "été", "ΩΜΕΓΑ", "X", "x"]
    out = []
    for _ in range(240):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "Z", None, "ä"])
        out.append((" ".join(rng.choice(words[: rng.choice([5, 40, 96])]) + rng.choice(["", ".", "1", "-"]) for _ in range(rng.randrange(0, 60))), lang, source))
    out += [(None, "en", "a"), ("", "en", "only here"), ("...", "xx", "p"), ("one two", "xx", "q"), ("solo solo", "yy", "one"), out[0], out[0]]
    return out


def test_equals_the_plain_version(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_small_pieces_and_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PAIRS", 16)
    monkeypatch.setattr(divergence.terms, "PIECE", 40)
    assert found(spark, rows, top=7) == plain(rows, 7)


def test_language_without_kept_terms_has_pairs_at_zero(spark):
    assert found(spark, [("one two", "xx", "q"), ("...", "xx", "p")]) == [("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_long_text_and_ties(spark):
    rows = [("ab cd " * 300_000, "en", "s"), ("ab cd", "en", "t"), ("cd ab", "en", "t"), ("ab cd", "en", "t")]
    assert found(spark, rows) == plain(rows)


def test_share_is_exact_beyond_64_bits(spark):
    pairs = [(c, n) for c in (0, 5, 8_999_999_998, 8_999_999_999, 9_000_000_000, 10**13) for n in (10**13 + 7, 3 * 10**13)]
    got = spark.createDataFrame(pairs, "c long, n long").select("c", "n", divergence.share_of(F.col("c"), F.col("n")).cast("long").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.n for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    names = ["lang", "source", "part", "item", "value", "rank"]
    got = QUERIES["op11_divergence"](spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT {', '.join(names)} FROM ({ORACLE['op11_divergence']})").fetchall())
