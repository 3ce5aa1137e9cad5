"""Ranked lexical search over document-sharded postings with integer impacts.

A task turns its documents into shards as they come: compressed sparse rows of postings
(term, document, impact), no shuffle.  An impact is all of a term's score in a document but
the weight of the term, which follows from the lexicon, the one table that is shuffled.
A search looks up the weights of the terms it asks for, and each task scores its shards
term at a time into a dense accumulator, keeps the k best of each item over all its shards,
and a window merges what the tasks kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm import terms
from emberline.scratch import drop, stage

#: fixed values of the weighting: B of 100 parts of the length count, K1 in eighths of a hundredth
LENGTH_SHARE = 90
K1 = 8
IMPACT = 1_000_000_000
#: postings and documents of a shard, about
POSTINGS = 1 << 20
SHARD_DOCS = 1 << 15
#: asked (item, term) rows that a search hands to every task at once, about
BLOCK_TERMS = 200_000
TABLE = terms.table(digits=True)

SHARDS = "docs array<long>, terms binary, starts binary, places binary, impacts binary"


@dataclass
class LexicalIndex:
    """shards (docs, terms, starts, places, impacts), lexicon (term, df), and the counts N and L."""

    shards: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int

    def drop(self) -> None:
        """Delete the staged tables."""
        drop(self.shards), drop(self.lexicon)


class _Shard:
    """Postings of some documents, gathered one by one."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.docs: list[int | None] = []
        self.norms: list[int] = []
        self.term: list[int] = []
        self.counts: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, counts: Counter, norm: int) -> None:
        ids = self.ids
        self.docs.append(doc_id)
        self.norms.append(norm)
        self.sizes.append(len(counts))
        self.term.extend([ids.setdefault(t, len(ids)) for t in counts])
        self.counts.extend(counts.values())

    def full(self) -> bool:
        return len(self.term) >= POSTINGS or len(self.docs) >= SHARD_DOCS

    def batch(self) -> pa.RecordBatch:
        """One row: documents by id, null last, and for each term its documents in that order with their impacts."""
        n = len(self.docs)
        order = sorted(range(n), key=lambda i: (self.docs[i] is None, self.docs[i] or 0))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        term, tf = np.array(self.term, np.int64), np.array(self.counts, np.int64)
        doc = np.repeat(place, self.sizes)
        by_term = np.lexsort((doc, term))
        norm = np.repeat(np.array(self.norms, np.int64), self.sizes)
        impact = (IMPACT * tf) // (1000 * tf + K1 * norm)
        starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(self.ids)))]
        blobs = [b" ".join(self.ids), starts.astype("<i4").tobytes(), doc[by_term].astype("<i4").tobytes(), impact[by_term].astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([[self.docs[i] for i in order]], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in blobs)], ["docs", "terms", "starts", "places", "impacts"])


def _lengths(batches):
    """(documents with terms, terms) of a task."""
    docs = total = 0
    for b in batches:
        n = terms.lengths(b.column(0), TABLE)
        docs, total = docs + int(np.count_nonzero(n)), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["n_docs", "n_terms"])


def _sharded(n_docs: int, n_terms: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), terms.folded(b.column(1), TABLE), strict=True):
                counts, n = Counter(), 0
                for words in terms.pieces(text):
                    counts.update(words)
                    n += len(words)
                if n:
                    shard.add(doc_id, counts, 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms)
                if shard.full():
                    yield shard.batch()
                    shard = _Shard()
        if shard.docs:
            yield shard.batch()

    return run


def _words(blob: bytes) -> pa.Array:
    return pa.array(blob.split(b" "), pa.binary())


def _frequencies(batches):
    """(term, df) of each shard."""
    for b in batches:
        for blob, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([_words(blob).cast(pa.string()), pa.array(np.diff(np.frombuffer(starts, "<i4")).astype(np.int64))], ["term", "df"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of all rows of docs over their whole texts.

    Each row is a document of its own, repeated ids too.  Null texts and texts without a
    term are in no shard and not counted.  Null ids are kept and rank last among equal
    scores.  Further columns are not read; an empty table gives an empty index.  The driver
    sees two counts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(_lengths, "n_docs long, n_terms long")
    n_docs, n_terms = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    shards = stage(rows.mapInArrow(_sharded(n_docs, n_terms), SHARDS), "shards")
    each = shards.select("terms", "starts").mapInArrow(_frequencies, "term string, df long")
    return LexicalIndex(shards, stage(each.groupBy("term").agg(F.sum("df").alias("df")), "lexicon"), n_docs, n_terms)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; of equal ones at the border the first places."""
    at_least = 1
    if len(scores) > k:
        at_least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    above = np.flatnonzero(scores > at_least)
    equal = np.flatnonzero(scores == at_least)
    return np.concatenate([above, equal[: max(0, k - len(above))]])


def _scored(asked: pa.Array, item_of: np.ndarray, term_of: np.ndarray, weight_of: np.ndarray, n_items: int, k: int):
    """asked: distinct terms; the rows (item, place in asked, weight) are in order of item."""
    ends = np.searchsorted(item_of, np.arange(n_items + 1))

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in range(n_items)]
        for b in batches:
            for row in range(b.num_rows):
                docs, blob, starts, places, impacts = (c[row].as_py() for c in b.columns)
                starts, places, impacts = (np.frombuffer(x, "<i4") for x in (starts, places, impacts))
                local = pc.fill_null(pc.index_in(asked, value_set=_words(blob)), -1).to_numpy(zero_copy_only=False)
                scores = np.zeros(len(docs), np.int64)
                for item in range(n_items):
                    rows = slice(ends[item], ends[item + 1])
                    there = local[term_of[rows]]
                    found = np.flatnonzero(there >= 0)
                    if not len(found):
                        continue
                    scores[:] = 0
                    for term, weight in zip(there[found].tolist(), weight_of[rows][found].tolist(), strict=True):
                        part = slice(starts[term], starts[term + 1])
                        scores[places[part]] += weight * impacts[part].astype(np.int64)
                    top = best(scores, k)
                    if len(top):
                        more = [(-s, docs[p] is None, docs[p] or 0) for s, p in zip(scores[top].tolist(), top.tolist(), strict=True)]
                        kept[item] = sorted(kept[item] + more)[:k]
        rows = [(i, None if none else doc, -s) for i, found in enumerate(kept) for s, none, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], ["item", "doc_id", "score"])

    return run


def _asked(batches):
    """(item, term): the distinct terms of each item."""
    for b in batches:
        items, words = [], []
        for item, text in zip(b.column(0).to_pylist(), terms.folded(b.column(1), TABLE), strict=True):
            known = {w for some in terms.pieces(text) for w in some}
            items += [item] * len(known)
            words += known
        yield pa.RecordBatch.from_arrays([pa.array(items, b.column(0).type), pa.array(words, pa.binary()).cast(pa.string())], ["item_id", "term"])


def search(index: LexicalIndex, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, in order of score and id.

    Rows of one item_id are one item with the terms of all of them; a null item_id is an
    item as well.  Items without a term that occurs in a document give no rows.  Items go
    to the tasks in blocks of about BLOCK_TERMS terms, so the driver and a task hold one
    block at a time, however many items there are.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    asked = rows.mapInArrow(_asked, f"item_id {kind}, term string").distinct()
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("long")
    wanted = stage(asked.join(index.lexicon, "term").select("item_id", "term", weight.alias("weight")), "asked")
    blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = []
    for number in range(blocks):
        t = wanted.where(block == number).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        codes = t["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        words = t["term"].combine_chunks().cast(pa.binary()).dictionary_encode()
        order = np.argsort(codes.indices.to_numpy(), kind="stable")
        item_of, term_of, weights = codes.indices.to_numpy()[order], words.indices.to_numpy()[order], t["weight"].to_numpy()[order]
        names = codes.dictionary
        scored = index.shards.mapInArrow(_scored(words.dictionary, item_of, term_of, weights, len(names), k), "item int, doc_id long, score long")
        found.append(scored.mapInArrow(_named(names), f"item_id {kind}, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _named(names: pa.Array):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2)], ["item_id", "doc_id", "score"])

    return run
