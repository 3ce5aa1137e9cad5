import hashlib

import numpy as np
import pytest

from emberline.llm import suffix


def brute(rows):
    """(id, bytes, removed mask) by a table of all strings."""
    first = {}
    big = suffix.NO_ID
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, big), big if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (big if d is None else d):
                gone[k : k + 50] = True
        out.append((d, b, gone))
    return out


def spans(gone):
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))


def case():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words, n))
    passages = [say(n) for n in (9, 10, 11, 12, 14, 20, 40, 200)]
    rows = [(i, " ".join(x for p in rng.permutation(len(passages))[:4] for x in (say(int(rng.integers(0, 12))), passages[p]))) for i in range(60)]
    copy = rows[3][1]
    rows += [(100 + i, copy) for i in range(5)]
    for i in range(20):
        b = list(copy)
        for _ in range(i % 4):
            b[int(rng.integers(len(b)))] = "#"
        rows.append((200 + i, "".join(b)))
    rows += [(300, None), (301, ""), (302, "a" * 400), (303, "a" * 60), (304, "ab" * 90), (305, "x" * 49), (306, "x" * 50), (307, "x" * 50), (None, copy), (None, "x" * 50), (7, copy), (7, "a" * 70), (7, "a" * 70)]
    return rows


@pytest.mark.parametrize(("crowd", "piece"), [(512, 1 << 20), (1, 3000), (4, 500)])
def test_equals_brute_force(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffix, "DOC_PART_BYTES", 20_000)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 9_000 if crowd == 4 else 16 << 20)
    monkeypatch.setattr(suffix, "SORT_PART", 400)
    monkeypatch.setattr(suffix, "CUT", 60)
    monkeypatch.setattr(suffix, "MAX_PARTS", 5 if piece == 500 else 4096)
    rows = case()
    docs = spark.createDataFrame([(d, t, "s", b"") for d, t in rows], "doc_id long, text string, spans string, kept binary").repartition(5)
    found = suffix.remove_repeats(docs).collect()
    show = lambda d, n, r, s, k: (d is None, d or 0, n, r, s, hashlib.sha256(k).hexdigest())
    got = sorted(show(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found)
    expected = sorted(show(d, len(b), int(g.sum()), spans(g), bytes(np.frombuffer(b, np.uint8)[~g])) for d, b, g in brute(rows))
    assert got == expected


def test_anchor_in_every_window():
    rng = np.random.default_rng(2)
    for text in (bytes(rng.integers(97, 100, 3000, np.uint8)), b"a" * 200, b"ab" * 100, bytes(50)):
        data = np.frombuffer(text, np.uint8)
        at, _ = suffix.anchors(data, np.array([len(text)]), np.array([len(text)]))
        for k in range(len(text) - 49):
            assert ((at >= k) & (at <= k + suffix.REACH)).any()


def test_hash_of_substrings():
    data = np.random.default_rng(1).integers(0, 256, 500, np.uint8)
    h = suffix.Hasher(np.concatenate([data, data]))
    a = np.arange(400)
    assert (h.of(a, a + 60) == h.of(a + 500, a + 560)).all()
    assert len(np.unique(h.of(a, a + 60))) == 400


def memory_of(work):
    """Peak bytes that numpy and Python take beside what there was."""
    import tracemalloc

    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


@pytest.mark.parametrize("text", [b"a" * (4 << 20), b"abcdefg" * (1 << 17)])
def test_a_short_period_takes_little_memory(text):
    import pyarrow as pa

    parts = suffix.Parts(8, 8, np.arange(8), np.arange(8))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[3:]])], ["doc_id", "text"])
    rows, peak = memory_of(lambda: [r for b in suffix._first_pass(parts, 512)([batch]) for r in b.to_pylist()])
    assert peak < 200 << 20
    entries = [suffix._unpack_entries(r["blob"])[0] for r in rows if r["kind"] == suffix.ENTRIES]
    assert 0 < sum(map(len, entries)) < 1000
    (first, last), peak = memory_of(lambda: suffix._again(np.frombuffer(text, np.uint8), np.array([100]), np.array([200])))
    assert peak < 300 << 20
    low, high = suffix._merged(first, last)
    assert (high - low).sum() >= len(text) - 2 * suffix.MARGIN


def test_long_periodic_texts_against_each_other(spark):
    rows = [(5, "a" * 300_000), (3, "a" * 90 + "b" + "a" * 70_000), (9, "abcdefg" * 100_000 + "x" * 49), (8, "bcdefga" * 30)]
    found = {r.doc_id: (r.n_removed, [(x.start, x.end) for x in r.spans]) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {3: (0, []), 5: (300_000, [(0, 300_000)]), 8: (0, []), 9: (700_000, [(0, 700_000)])}


@pytest.mark.parametrize("low", [-(2**63), -5])
def test_null_is_larger_than_the_largest_id(spark, low):
    text = "0123456789" * 5 + "abc"
    rows = [(2**63 - 1, text), (None, text), (low, "x"), (low + 1, "y"), (2**63 - 2, text[::-1])]
    found = {r.doc_id: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {2**63 - 1: 0, None: 53, low: 0, low + 1: 0, 2**63 - 2: 0}


def test_equal_hashes_of_unequal_bytes_are_told_apart(monkeypatch):
    rng = np.random.default_rng(0)
    around = np.repeat(rng.integers(0, 256, (1, 84), np.uint8), 4, axis=0)
    around[2:, :34] += 1
    around[3, 60:] += 1
    out = suffix._Out(suffix.Parts(1, 1, np.arange(1), np.arange(1)))
    columns = (around, np.full((4, 2), 34, np.uint8), np.arange(4), np.arange(4).astype(np.uint64), np.full(4, 100))
    plain = suffix._mix
    suffix._settle_slice(*columns, range(17, 35), out)
    expected = [suffix._unpack(r[3]) for r in out.rows]
    monkeypatch.setattr(suffix, "_mix", lambda x: plain(x) * np.uint64(0))
    out.rows = []
    suffix._settle_slice(*columns, range(17, 35), out)
    assert repr([suffix._unpack(r[3]) for r in out.rows]) == repr(expected) and expected


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
