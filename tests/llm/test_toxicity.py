import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import toxicity as T

BAD = ["scum", "trash", "idiot", "loser"]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words, junk = [f"wort{i}" for i in range(200)], [f"junk{i}" for i in range(50)]
    rows = []
    for i in range(n):
        toxic, low = i % 7 == 0, i % 5 == 0
        text = list(rng.choice(junk if low else words, int(rng.integers(20, 80))))
        if toxic:
            text[:: max(1, len(text) // 3)] = list(rng.choice(BAD, len(text[:: max(1, len(text) // 3)])))
        rows.append((i, " ".join(text), int(not low), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([(i, t, 9.9) for i, t, _, _ in rows], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 400] + [(3, None, 1), (None, 1, 1), (5, 0, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(spark, tables):
    rows, docs, labels = tables
    chain = T.train(docs, labels, T.CATEGORIES)
    scored = T.score(docs, chain).withColumn("rejected", T.rejected(chain))
    assert scored.columns == ["doc_id", "text", "p_low_quality", "p_toxic", "rejected"]
    held = [r for r in scored.collect() if r.doc_id >= 400]
    right = sum(r.rejected == (r.doc_id % 7 == 0) for r in held)
    assert right >= 0.98 * len(held)
    assert sum((r.p_low_quality >= 0.5) == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)


def test_fit_equals_gradient_zero():
    rng = np.random.default_rng(1)
    x = rng.random((80, 12)) < 0.3
    y = (x[:, 0] | (rng.random(80) < 0.2)).astype(float)
    rows = T.Rows(np.nonzero(x)[1].astype(np.int32), np.r_[0, np.cumsum(x.sum(1))], 12)
    w = T.fit_logistic(rows, np.zeros((80, 0)), y, ridge=0.5, steps=200, tolerance=1e-12)
    p = 1 / (1 + np.exp(-(x @ w[:12] + w[12])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:12]).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_later_links_see_out_of_fold_scores():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 40, 10)).astype(np.uint32) for _ in range(90)]
    a = np.array([int(0 in t) for t in texts])
    chain = T.fit_chain(texts, np.column_stack([a, a]), np.arange(90) % 3, ["a", "b"])
    assert chain.links[0] == [] and len(chain.links[1]) == 1 and chain.links[1][0] > 0


@pytest.mark.parametrize("rows", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_labels_nothing_is_rejected(spark, rows):
    docs = spark.createDataFrame([(1, "scum"), (2, None), (None, "")], "doc_id long, text string")
    chain = T.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), T.CATEGORIES)
    assert T.score(docs, chain).where(T.rejected(chain)).count() == 0


def test_empty_documents(spark, tables):
    _, docs, labels = tables
    chain = T.train(docs, labels, T.CATEGORIES, max_train=100)
    assert T.score(docs.limit(0), chain).collect() == []
    nulls = T.score(docs.limit(3).withColumn("text", F.lit(None).cast("string")), chain).collect()
    assert len({r.p_toxic for r in nulls}) == 1 and nulls[0].p_toxic < 0.5


def test_threshold():
    assert T.best_threshold(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1, 1, 0, 0])) == pytest.approx(1 / (1 + np.exp(-0.5)))
    assert T.best_threshold(np.array([1.0]), np.array([0])) == 0.5


def test_repeated_and_contradicting_labels_do_not_depend_on_order(spark):
    words = ["nice day", "good book", "vile scum", "rotten scum", "calm sea", "vile trash"]
    docs = [(i % 40, f"{words[i % 6]} {words[(i * 7) % 6]} item{i % 11}", None) for i in range(160)] + [(None, "x", None), (3, None, None), (4, "", None)]
    labels = [(i % 40, (i % 3 > 0) * 1, (i % 6 in (2, 3, 5)) * 1) for i in range(70)] + [(None, 1, 1), (2, None, 1), (5, 1, None)]
    made = []
    for seed in (1, 2):
        d = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string").repartition(5).orderBy(F.rand(seed))
        chain = T.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").orderBy(F.rand(seed + 9)).repartition(3), T.CATEGORIES)
        made.append((chain.ids.tolist(), chain.weights.tolist(), chain.links, chain.bias, chain.threshold))
        out = T.score(d, chain)
        assert out.count() == len(docs) and out.columns == ["doc_id", "text", "p_low_quality", "p_toxic"]
    assert made[0] == made[1]


def test_a_very_long_and_repetitive_text(spark):
    chain = T.train(spark.createDataFrame([(1, "bad"), (2, "good")], "doc_id long, text string"), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"), T.CATEGORIES)
    out = T.score(spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word bad "), 200_000).alias("text")), chain)
    assert 0 <= out.first().p_toxic <= 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    chain = T.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), T.CATEGORIES)
    assert T.score(docs, chain).collect() == []


def plain_features(text):
    """Words and the stems of longer ones, one by one."""
    import re
    import zlib

    out = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.add(zlib.crc32(word.encode()))
        for n in (3, 4, 5):
            if len(word) > n:
                out.add(zlib.crc32((word[:n] + "*").encode()))
    return out


def newton(x, y, ridge):
    """Ridge logistic model by Newton steps on a dense matrix, the bias last and free."""
    x = np.column_stack([x, np.ones(len(x))])
    free = np.r_[np.full(x.shape[1] - 1, ridge), 0.0]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(free) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + free * w)
    return w


def test_chain_equals_a_plain_one():
    """Dense features, Newton steps and loops give the probabilities and the threshold of the chain."""
    rows = corpus(160, seed=4)
    texts, labels = [t for _, t, _, _ in rows], np.array([[1 - q, x] for _, _, q, x in rows])
    folds = np.arange(len(rows)) % T.FOLDS
    chain = T.fit_chain([T.features(t) for t in texts], labels, folds, ["low", "toxic"])

    sets = [plain_features(t) for t in texts]
    known = sorted(f for f in set().union(*sets) if sum(f in s for s in sets) > 1)
    wide = lambda some: np.array([[float(f in s) for f in known] for s in some])
    new = [t for _, t, _, _ in corpus(60, seed=9)]
    x, asked, earlier = wide(sets), wide([plain_features(t) for t in new]), np.zeros((len(new), 0))
    for k in range(2):
        y, apart = labels[:, k].astype(float), np.zeros(len(rows))
        for f in range(T.FOLDS):
            w = newton(x[folds != f], y[folds != f], T.RIDGE)
            apart[folds == f] = x[folds == f] @ w[:-1] + w[-1]
        w = newton(x, y, T.RIDGE)
        earlier = np.column_stack([earlier, asked @ w[:-1] + w[-1]])
        x, asked = np.column_stack([x, apart]), np.column_stack([asked, earlier[:, k]])
    chance = lambda z: 1 / (1 + np.exp(-z))
    assert np.abs(chance(chain.logits([T.features(t) for t in new])) - chance(earlier)).max() < 0.03

    def quality(cut):
        hit = apart >= cut
        return 1.25 * (hit & (y == 1)).sum() / (hit.sum() + 0.25 * y.sum())

    best = max(quality(c) for c in apart)
    assert quality(np.log(chain.threshold / (1 - chain.threshold))) >= best - 0.02 or chain.threshold == T.LEAST_THRESHOLD
