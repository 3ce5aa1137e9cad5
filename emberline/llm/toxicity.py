"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after another; the model of each sees the words of a text
and the logits of the categories before it.  Those logits come from out-of-fold models
while fitting, so a later model learns from what the earlier one will really say.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import widened

#: labelled documents used for fitting, at most
MAX_TRAIN = 6_000
FOLDS = 3
RIDGE = 0.1
#: with few labels the out-of-fold scores say little about thresholds below this
LEAST_THRESHOLD = 0.1
#: texts scored at once
SCORED = 512
#: letters of a stem
STEMS = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Checksums of the distinct words of a whole text, and of the stems of the longer ones."""
    words = set(_WORD.findall((text or "").lower()))
    words = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))


class Rows:
    """Sparse binary rows, kept by row and by column so that both products read in order."""

    def __init__(self, idx: np.ndarray, ptr: np.ndarray, width: int):
        """The columns of row i are idx[ptr[i]:ptr[i + 1]]."""
        self.idx, self.ptr, self.width = idx.astype(np.int64), ptr, width
        row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        self.by_column = row[np.argsort(self.idx, kind="stable")]
        self.counts = np.bincount(self.idx, minlength=width)
        self.full_rows, self.full_columns = np.flatnonzero(np.diff(ptr)), np.flatnonzero(self.counts)
        self.row_starts, self.column_starts = ptr[self.full_rows], (np.cumsum(self.counts) - self.counts)[self.full_columns]

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.ptr)
        return Rows(self.idx[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[keep])], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ptr) - 1)
        if len(self.idx):
            out[self.full_rows] = np.add.reduceat(w[self.idx], self.row_starts)
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.idx):
            out[self.full_columns] = np.add.reduceat(r[self.by_column], self.column_starts)
        return out


def fit_logistic(rows: Rows, dense: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 60, tolerance: float = 1e-5) -> np.ndarray:
    """Weights (words, dense columns, bias) of a ridge logistic model.

    L-BFGS on a diagonal guess of the curvature, which evens out rare and common words.
    """
    n, d = len(y), dense.shape[1]
    size = rows.width + d + 1
    if n == 0 or y.min() == y.max():
        w = np.zeros(size)
        w[-1] = 0.0 if n == 0 else (12.0 if y[0] else -12.0)
        return w if n else w - np.r_[np.zeros(size - 1), 12.0]

    def value(w):
        z = rows.dot(w[: rows.width]) + dense @ w[rows.width : -1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = np.sum(np.logaddexp(0, z) - y * z) + 0.5 * ridge * np.sum(w[:-1] ** 2)
        r = p - y
        return loss, np.r_[rows.back(r), dense.T @ r, r.sum()] + ridge * np.r_[w[:-1], 0.0]

    share = y.mean()
    spread = np.r_[rows.counts, (dense**2).sum(0), n] * share * (1 - share) + np.r_[np.full(size - 1, ridge), 0.0]
    w, memory = np.zeros(size), []
    w[-1] = np.log(share / (1 - share))
    f, g = value(w)
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, t, rho in reversed(memory):
            alphas.append(a := rho * (s @ q))
            q -= a * t
        q /= spread
        if memory:
            s, t, _ = memory[-1]
            q *= (s @ t) / (t @ (t / spread))
        for (s, t, rho), a in zip(memory, reversed(alphas), strict=True):
            q += s * (a - rho * (t @ q))
        step, slope = 1.0, g @ q
        for _ in range(20):
            f2, g2 = value(w - step * q)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, g2 - g
        if s @ t > 1e-10:
            memory = [*memory[-9:], (s, t, 1 / (s @ t))]
        w, done, f, g = w - step * q, abs(f - f2) < tolerance * (1 + abs(f)), f2, g2
        if done:
            break
    return w


@dataclass
class Chain:
    """Weights of each feature (ids, in order) by category; links: of the earlier logits; bias.

    threshold: the probability of the last category from which a text is rejected.
    """

    categories: list[str]
    ids: np.ndarray
    weights: np.ndarray
    links: list[list[float]]
    bias: list[float]
    threshold: float

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row of logits for each text's features."""
        sizes = [len(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), sizes)
        told = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        at = np.searchsorted(self.ids, told)
        known = np.flatnonzero(at < len(self.ids))
        known = known[self.ids[at[known]] == told[known]]
        out = np.zeros((len(texts), len(self.categories)))
        for k, link in enumerate(self.links):
            out[:, k] = np.bincount(row[known], weights=self.weights[at[known], k], minlength=len(texts)) + self.bias[k]
            out[:, k] += out[:, :k] @ np.array(link)
        return out


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F0.5 is highest on out-of-fold logits, midway to the next one; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-logits, kind="stable")
    z, hits = logits[order], np.cumsum(y[order])
    quality = 1.25 * hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    quality[:-1][z[:-1] == z[1:]] = -1.0  # equal logits stay together
    k = int(np.argmax(quality))
    cut = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1
    return max(LEAST_THRESHOLD, float(1 / (1 + np.exp(-cut))))


def _table(texts: list[np.ndarray]) -> tuple[np.ndarray, Rows]:
    """The features that more than one text has, in order, and the texts as rows over them."""
    told = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    ids, at, counts = np.unique(told, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    keep = (counts > 1)[at]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])[keep]
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    return ids[counts > 1], Rows(place[at[keep]], np.r_[0, ends].astype(np.int64), int((counts > 1).sum()))


def fit_chain(texts: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, categories: list[str], ridge: float = RIDGE) -> Chain:
    """labels: a column of 0 or 1 for each category; features of one text only are left out."""
    ids, rows = _table(texts)
    dense, weights, links, bias = np.zeros((len(texts), 0)), [], [], []
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        apart = np.zeros(len(texts))
        for f in np.unique(folds):
            fit, held = folds != f, folds == f
            w = fit_logistic(rows.take(fit), dense[fit], y[fit], ridge)
            apart[held] = rows.take(held).dot(w[: rows.width]) + dense[held] @ w[rows.width : -1] + w[-1]
        w = fit_logistic(rows, dense, y, ridge)
        weights.append(w[: rows.width]), links.append(w[rows.width : -1].tolist()), bias.append(float(w[-1]))
        dense = np.column_stack([dense, apart])
    return Chain(categories, ids, np.column_stack(weights), links, bias, best_threshold(apart, y))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_train: int = MAX_TRAIN, folds: int = FOLDS, ridge: float = RIDGE) -> Chain:
    """Fit a chain on at most max_train labelled documents, those with the smallest hashes.

    categories: name to SQL condition over the columns of labels, in the order of the
    chain.  A row with a null condition or a null id is left out; where labels of one id
    contradict each other the document has each category that any of them gives it.  Of
    documents with one id the text with the smallest hash counts, so the fit depends on
    the rows alone and not on their order.  Empty and null texts have no features.
    Without any labelled document every probability is near zero.  Further columns are
    not read.
    """
    names = [f"c{i}" for i in range(len(categories))]
    marks = [F.max(F.expr(c).cast("int")).alias(n) for n, c in zip(names, categories.values(), strict=True)]
    known = labels.where(" AND ".join(f"({c}) IS NOT NULL" for c in categories.values())).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        for b in batches:
            told = [np.sort(features(t.as_py())).tobytes() for t in b.column("text")]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(told, pa.binary()))

    # at most max_train rows of a few numbers are broadcast, and as many lists of features come back
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    found = found.groupBy("doc_id", *names).agg(least).select("doc_id", F.col("least.text").alias("text"), *names)
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in found.schema)
    found = sorted(found.mapInArrow(run, schema).collect(), key=lambda r: r["doc_id"])
    texts = [np.frombuffer(r["text"], np.uint32) for r in found]
    y = np.array([[r[n] for n in names] for r in found]).reshape(len(found), len(names))
    place = np.random.default_rng(0).permutation(len(texts)) % folds
    return fit_chain(texts, y, place, list(categories), ridge)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with a column p_<category> for each category (columns of that name are replaced).

    Whole texts are scored; null and empty texts have no words and get the probability
    that the biases give.
    """
    names = [f"p_{c}" for c in chain.categories]
    docs = docs.drop(*names)
    out = widened(docs, ", ".join(f"{n} double" for n in names))

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            parts = [chain.logits([features(t.as_py()) for t in texts.slice(at, SCORED)]) for at in range(0, len(texts), SCORED)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros((0, len(names))), *parts]), -35, 35)))
            for k, n in enumerate(names):
                b = b.append_column(n, pa.array(np.ascontiguousarray(p[:, k])))
            yield b

    return docs.mapInArrow(run, out)


def rejected(chain: Chain):
    """Condition on scored rows: the last category reaches the chain's threshold."""
    return F.col(f"p_{chain.categories[-1]}") >= chain.threshold


#: The chain of the label tables: poor quality first, then toxicity.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
