import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import embedding as E


def case(seed=1):
    rng = np.random.default_rng(seed)
    rows, n = [], 0

    def add(v, label, i=None):
        nonlocal n
        rows.append((n if i is None else i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label))
        n += 1

    for _ in range(500):
        add(rng.standard_normal(16), int(rng.integers(0, 3)))
    for size in (2, 3, 12, 150):
        c = rng.standard_normal(16)
        for _ in range(size):
            add(c + 0.05 * rng.standard_normal(16), 1)
    c = rng.standard_normal(16)
    for _ in range(60):
        add(c, 0)
    add(c * 2, 0), add(c, 2), add(c, None), add(None, 1), add(np.zeros(16), 1), add([np.nan, *c[1:]], 1), add([np.inf, *c[1:]], 1), add([None, *c[1:]], 1), add([], 1), add(c[:8], 0), add(c[:8], 0)
    add(c, 0, 5), add(c, 0, 5)
    return rows


def brute(rows):
    v, ok = [], []
    for _, x, label in rows:
        good = label is not None and x is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x)
        ok.append(good)
        a = np.array(x if good else [1.0], float)
        v.append(a / np.linalg.norm(a))
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_links_equal_brute_force(spark):
    rows = case()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert found == brute(rows)


def test_links_between_saturated_groups(spark):
    """Two tight groups, each larger than a neighbour list, that are linked with each other."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(64)
    b -= (b @ a) * a
    b = 0.9852 * a + np.sqrt(1 - 0.9852**2) * b / np.linalg.norm(b)
    tight = lambda c, n: [(c + 0.0006 * rng.standard_normal(64)).tolist() for _ in range(n)]
    rows = [(i, v, 1) for i, v in enumerate(tight(a, 25) + tight(b, 25) + [rng.standard_normal(64).tolist() for _ in range(300)])]
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect())
    assert found == brute(rows) and found[30][2] == 0 and found[0][1] == 49


def test_double_vectors_and_any_label(spark):
    rows = [(0, [1e300, 1e300], "a"), (1, [1e-60, 1e-60], "a"), (2, [1.0, 1.0 + 1e-12], "a"), (3, [1.0, 1.0], "b"), (4, [float("nan"), 1.0], "a"), (5, [-1.0, -1.0], "a"), (6, [0.0, 0.0], "a"), (7, [1.0, 1.0], None), (8, [5e-324, 0.0], "a")]
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "_recall", lambda *_: 0.5)
    monkeypatch.setattr(E, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="recall"):
        E.near_duplicates(spark.createDataFrame([(i, [1.0, float(i)], 1) for i in range(20)], "vec_id long, embedding array<float>, label int"))


def test_rare_links_among_many(spark, tmp_path):
    """100 000 vectors, one in a thousand linked: recall is measured on nodes that have neighbours."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((99_950, 16)).astype(np.float32)
    near = base[:50] + 0.05 * rng.standard_normal((50, 16)).astype(np.float32)
    v = np.concatenate([base, near])
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    true = 0
    for at in range(0, len(unit), 2000):
        true += int((unit[at : at + 2000] @ unit.T >= 0.98).sum()) - len(unit[at : at + 2000])
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 16).cast(pa.list_(pa.float32())), "label": np.zeros(len(v), np.int32)}), str(tmp_path / "v.parquet"))
    rows = spark.read.parquet(str(tmp_path / "v.parquet"))
    out = E.near_duplicates(rows).agg(F.sum("n_links").alias("n"), F.max("recall").alias("recall")).first()
    assert true >= 90 and out.n >= 0.95 * true and out.recall >= 0.98


def test_recall_on_scattered_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        c = rng.standard_normal(24)
        rows += [(2 * i, c.astype(np.float32).tolist(), i % 2), (2 * i + 1, (c + 0.1 * rng.standard_normal(24)).astype(np.float32).tolist(), i % 2)]
    found = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    true = 2 * sum(cosine(np.array(rows[2 * i][1]), np.array(rows[2 * i + 1][1])) >= 0.98 for i in range(1500))
    assert true > 1000 and sum(found.values()) >= 0.9 * true


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)]])
def test_small_tables(spark, rows):
    out = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(out) == len(rows)
    if len(rows) == 2:
        assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(None, 1, 3), (3, 1, 3)}
