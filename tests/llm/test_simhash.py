import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, n)) for n in (1, 3, 4, 5, 60, 200, 900, 3000)]
    out = [None, "", " \t\n", "ÄÖ Word", "äÖ wORD", "a b c d e", *base, *[b.upper() for b in base], *[b + " tail" for b in base]]
    for b in base[5:]:
        w = b.split()
        for k in range(6):
            w[int(rng.integers(len(w)))] = f"x{k}"
            out.append(" ".join(w))
    return out


def test_fingerprints_equal_brute_force():
    for t in texts():
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_long_text_in_pieces():
    t = " ".join(f"w{i * i % 977}" for i in range(140_000))
    assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 5000, np.uint64) for _ in range(2))
    b[:2500] = a[:2500] ^ (np.uint64(1) << rng.integers(0, 64, 2500, np.uint64))
    counts = lambda x: np.array([[(int(v) >> s & 3).bit_count() for s in range(0, 64, 2)] for v in x])
    expected = np.abs(counts(a) - counts(b)).sum(1)
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) == expected).all()
    assert (expected <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize(("cell_rows", "groups"), [(2048, 6), (8, 6), (2048, 7), (5, 8)])
def test_components_equal_brute_force(spark, monkeypatch, cell_rows, groups):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash, "groups_for", lambda n, bits=4: groups)
    rng = np.random.default_rng(groups)
    fps = rng.integers(-(2**63), 2**63, 40).tolist()
    for f in fps[:8]:
        for _ in range(12):
            f ^= int(np.int64(1) << np.int64(rng.integers(0, 63)))
            fps.append(f)
    fps = list(dict.fromkeys(fps))
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    from emberline.llm.components import components

    found = {r.node: r.root for r in components(simhash.links(rows)).collect()}
    roots = [found.get(f, f) for f in fps]
    expected = brute_components([f & (2**64 - 1) for f in fps], list(range(len(fps))))
    pairs = lambda xs: sorted(sorted(i for i, y in enumerate(xs) if y == x) for x in set(xs))
    assert pairs(roots) == pairs(expected)


def test_operator_with_nulls_ties_and_clashing_columns(spark):
    ts = texts()
    rows = [(i if i % 9 else None, t, "x", i) for i, t in enumerate(ts)] + [(5, ts[8], "x", 0), (5, ts[8], "x", 0), (5, ts[10], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    found = simhash.near_duplicates(docs).collect()
    fps = [brute_fingerprint(t) for _, t, _, _ in rows]
    expected = brute_components(fps, [r[0] for r in rows])
    key = lambda d, f, c: (d is None, d or 0, f, c is None, c or 0)
    assert sorted(key(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == sorted(key(d[0], f, c) for d, f, c in zip(rows, fps, expected, strict=True))
    kept = simhash.keep_one(docs, shingles=(4,))
    assert kept.columns == docs.columns
    roots = {r.root for r in found}
    assert kept.count() == len(roots)
    either = simhash.keep_one(docs)
    assert either.count() <= min(len(roots), simhash.keep_one(docs, shingles=(5,)).count())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def test_hex_of_the_query(spark, tmp_path):
    from emberline.llm.queries import QUERIES

    spark.createDataFrame([(1, "one two three four five"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.fingerprint for r in QUERIES["op1_simhash"](spark, str(tmp_path)).collect()}
    assert found == {1: f"{brute_fingerprint('one two three four five'):016x}", 2: "0" * 16}


def test_components_of_a_long_chain(spark):
    from emberline.llm.components import components

    edges = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    found = components(edges.union(edges).union(spark.createDataFrame([(7, 7), (None, 3), (1000, 999)], "u long, v long"))).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(400)} | {(999, 999), (1000, 999)}


def test_groups_join_both_lengths(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = simhash.fingerprints(docs, (5, 4)).collect()
    a, b = ([getattr(r, c) & (2**64 - 1) for r in rows] for c in ("fp", "fp1"))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (a[i] ^ a[j]).bit_count() <= 4 or (b[i] ^ b[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    found = {r.doc_id: r.root for r in simhash.groups(docs).collect()}
    pairs = lambda xs: sorted(sorted(i for i, y in enumerate(xs) if y == x) for x in set(xs))
    assert pairs([found[r.doc_id] for r in rows]) == pairs([find(i) for i in range(len(rows))])


def test_groups_join_all_texts_of_similarity(spark):
    rng = np.random.default_rng(8)
    rows = [*texts(), None, ""]
    for n in (40, 120, 400):
        for _ in range(12):
            base = [f"v{x}" for x in rng.integers(0, 5000, n)]
            rows.append(" ".join(base))
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                w = list(base)
                for at in rng.choice(n, max(1, round(share * n)), replace=False):
                    w[at] = f"x{rng.integers(10**6)}"
                rows.append(" ".join(w))
    sets = []
    for t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    fps = [[simhash.fingerprint((t or "").encode(), n) for t in rows] for n in (5, 4)]
    root, far = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            bits = min((f[i] ^ f[j]).bit_count() for f in fps)
            near = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            far += near and bits > 4
            if near or bits <= 4:
                root[find(i)] = find(j)
    assert far > 20
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.root for r in simhash.groups(docs, similarity=0.8).collect()}
    pairs = lambda xs: sorted(sorted(i for i, y in enumerate(xs) if y == x) for x in set(xs))
    assert pairs([found[i] for i in range(len(rows))]) == pairs([find(i) for i in range(len(rows))])
    assert simhash.keep_one(docs, similarity=0.8).count() == len({find(i) for i in range(len(rows))})


def _similar_by_hand(sets, similarity):
    from itertools import combinations

    near = lambda a, b: (not a and not b) or len(a & b) >= similarity * len(a | b)
    return {(i, j) for i, j in combinations(range(len(sets)), 2) if near(sets[i], sets[j])}


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_sets_that_meet_equal_brute_force(similarity):
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = set(rng.integers(0, 60, rng.integers(0, 30)).tolist())
        sets.append(base)
        if rng.random() < 0.6:
            sets.append({x for x in base if rng.random() < 0.93} | set(rng.integers(0, 60, 1).tolist()))
    root = np.arange(len(sets)) * 3
    packed = [np.array(sorted(s), np.uint64).tobytes() for s in sets]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int64)), pa.array(root), pa.array(packed, pa.binary())], ["key", "root", "shingles"])
    found, expected = list(range(len(sets))), list(range(len(sets)))

    def join(names, a, b):
        names[:] = [names[a] if x == names[b] else x for x in names]

    for b in simhash._all_met(similarity)([batch]):
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            assert (min(u, v) // 3, max(u, v) // 3) in _similar_by_hand(sets, similarity)
            join(found, u // 3, v // 3)
    for a, b in _similar_by_hand(sets, similarity):
        join(expected, a, b)
    groups = lambda names: {tuple(i for i, x in enumerate(names) if x == name) for name in names}
    assert groups(found) == groups(expected)


def test_many_texts_of_one_template_meet_quickly():
    """Texts of one key that share 700 of 1000 shingles: none is similar, and that takes little time."""
    import time

    n = 3_000
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    packed = [np.unique(np.r_[shared, rng.integers(0, 1 << 62, 300, dtype=np.uint64)]).tobytes() for _ in range(n)]
    packed.append(packed[5][:-8])
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n + 1, np.int64)), pa.array(np.arange(n + 1)), pa.array(packed, pa.binary())], ["key", "root", "shingles"])
    start = time.time()
    links = [(u, v) for b in simhash._all_met(0.8)([batch]) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert {tuple(sorted(x)) for x in links} == {(5, n)} and time.time() - start < 30


def test_blocks_of_a_crowded_key_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MET_ROWS", 5)
    left = spark.createDataFrame([(7, i, i * 11) for i in range(40)] + [(8, i, i * 11) for i in range(3)], "key long, root long, h long")
    met = {}
    for r in simhash._in_blocks(left).collect():
        met.setdefault(r.key, set()).add(r.h)
    assert max(map(len, met.values())) < 30
    assert all(any({a * 11, b * 11} <= m for m in met.values()) for a in range(40) for b in range(a))
    assert met[8] == {0, 11, 22}


def test_texts_within_reach_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        root, size = np.sort(rng.integers(0, 3, n)), rng.integers(1, 30, n)
        near = [any(root[i] != root[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) for j in range(n)) for i in range(n)]
        assert simhash._within_reach(root, size, 0.8).tolist() == near


def test_a_pair_is_compared_once(spark, monkeypatch):
    """Pairs that share keys and are not similar are decided by one comparison each; whole sets meet only where three texts do."""
    words = lambda i, n=200: [f"w{i}-{k}" for k in range(n)]
    rows = []
    for i in range(60):  # every second text has new words at its end: similarity about 0.6
        rows += [" ".join(words(i)), " ".join(words(i, 150) + words(1000 + i, 50))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    seen, plain = {}, simhash.stage

    def stage(df, label="t"):
        out = plain(df, label)
        seen.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stage", stage)
    assert simhash.keep_one(docs, similarity=0.8).count() == 120
    assert 20 < seen["candidates"][0] <= 60 and seen["keys"][0] == 2 * seen["candidates"][0] and seen["candidate-sets"] == [0]


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_texts_stay_where_they_are(spark, monkeypatch, bits):
    """Finding and dropping copies moves few texts; a filter that is too small for what it is asked loses nothing."""
    monkeypatch.setattr(simhash, "FILTER_BITS", bits)
    rng = np.random.default_rng(9)
    rows = [" ".join(rng.integers(10**8, 10**9, 1000).astype(str)) for _ in range(300)]
    rows += [rows[i] for i in range(10)] + [rows[i].replace(rows[i][:9], "x", 1) for i in range(10, 20)] + [None, None]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(rows)], "doc_id long, text string")
    state = spark.sparkContext._jsc.sc()

    def moved():
        state.listenerBus().waitUntilEmpty()
        return state.statusStore().executorList(False).head().totalShuffleWrite()

    before, threshold = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs, similarity=0.8).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(kept) == 301 and len({r.text for r in kept}) == 301
    if bits > 64:
        assert moved() - before < sum(len(t or "") for t in rows) / 2
