"""Benchmark decontamination by greedy string tiling.

Shared runs of `min_match` words are the seeds, found by a rolling hash over word numbers
(Karp and Rabin).  Then, document and item by item, the longest unmarked match is marked
again and again, never overlapping, in the document nor in the item.  The share of an
item's words that end up under tiles is its coverage; since tiles may lie in any order, a
reordered passage is caught as well.

The length of the longest match is found by halving, with a rolling hash of both sides for
each length that is tried, and all matches of that length are marked in one walk, so no
pairs of positions are kept.  Runs of the document that are shared with the item stand for
it; of equal runs as many stay as there can be tiles.

A benchmark of up to BLOCK_BYTES is an index that every task gets, and documents do not
move.  A larger one is joined by its seeds: only seeds that some item has leave the
documents, and only documents that share one meet the items, one after another.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import free, widened
from emberline.scratch import drop, stage

MIN_MATCH = 5
COVERAGE = 0.6
#: bytes of benchmark text that one index may hold
BLOCK_BYTES = 8 << 20
#: bits of the filter of seeds that every task gets: 16 MB
FILTER_BITS = 1 << 27
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> U(29))


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n numbers, in steps that double."""
    if len(ids) < n:
        return np.zeros(0, U)
    out, have, at = None, 0, ids.astype(U) + U(1)
    power, width = _BASE, 1  # at: hashes of runs of `width`, power: _BASE ** width
    left = n
    while True:
        if left & 1:
            if out is None:
                out, have = at, width
            else:  # runs of `width` before those that are at hand
                size = len(ids) - (have + width) + 1
                out = at[:size] * _power(_BASE, have) + out[width : width + size]
                have += width
        left >>= 1
        if not left:
            return _mix(out)
        size = len(at) - width
        if size <= 0:
            return np.zeros(0, U)
        at = at[:size] * power + at[width : width + size]
        width *= 2
        power = _power(_BASE, width)


def _power(base, n: int):
    return U(pow(int(base), n, 1 << 64))


class Index:
    """Word numbers and hashed runs of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.min_match, self.number, self.items = min_match, {}, []
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int32)))
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        #: how often a run can occur in an item at most: as often as its most frequent word
        self.times = np.array([np.unique(ids, return_counts=True)[1].max() for _, ids in self.items], np.int64)
        self.runs = {m: self._runs(m) for m in sorted(set(np.minimum(min_match, self.sizes).tolist()))}

    def _runs(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of runs of m words, where the items of each begin, those items, and a filter of hashes."""
        own = [k for k, n in enumerate(self.sizes.tolist()) if min(self.min_match, n) == m]
        hashes = [np.unique(rolling(self.items[k][1], m)) for k in own]
        which = np.repeat(own, [len(h) for h in hashes]).astype(np.int32)
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        known, first = np.unique(flat[order], return_index=True)
        small = np.zeros(1 << 20, bool)
        small[(known >> U(44)).astype(np.int64)] = True
        return known, np.r_[first, len(flat)], which[order], small

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def seeds(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ids where a run of m words of some item may begin, and the number of its hash."""
        known, _, _, small = self.runs[m]
        n = len(ids) - m + 1
        unknown = np.cumsum(np.r_[0, ids < 0])
        at = np.flatnonzero(unknown[m:] == unknown[: max(n, 0)])
        if not len(at):
            return at, at
        h = rolling(ids, m)[at]
        maybe = small[(h >> U(44)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        return at[hit], place[hit]

    def bounds(self, seeds: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Items that share a seed, and a bound for the share of their words that tiles can cover; best bound first."""
        words = np.zeros(len(self.items), np.int64)
        for m, (_, hashed) in seeds.items():
            _, first, which, _ = self.runs[m]
            h = np.unique(hashed)
            sizes = first[h + 1] - first[h]
            at = np.arange(sizes.sum()) + np.repeat(first[h] - np.cumsum(sizes) + sizes, sizes)
            words += m * np.bincount(which[at], minlength=len(words))
        at = np.flatnonzero(words)
        most = np.minimum(1.0, words[at] * self.times[at] / self.sizes[at])
        order = np.lexsort((at, -most))
        return at[order], most[order]


def _shared_runs(doc: np.ndarray, item: np.ndarray, m: int) -> list[np.ndarray]:
    """Longest runs of doc all of whose seeds are in item; of equal ones no more than there can be tiles."""
    at = np.flatnonzero(np.isin(rolling(doc, m), rolling(item, m)))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + m
    most, kept, seen = max(1, len(item) // m), [], {}
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        run = doc[a:z]
        key = run.tobytes()
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= most:
            kept.append(run)
    return kept


def tile(doc: np.ndarray, item: np.ndarray, m: int) -> int:
    """Words of item under tiles of m words or more, the longest first; numbers in doc that item lacks match nothing."""
    runs = _shared_runs(doc, item, m)
    if not runs:
        return 0
    gap = np.full(1, -1, np.int64)
    text = np.concatenate([x for r in runs for x in (r, gap)])
    free_text, free_item = text >= 0, np.ones(len(item), bool)
    covered, longest = 0, min(len(item), max(map(len, runs)))

    def open_at(free: np.ndarray, n: int) -> np.ndarray:
        taken = np.cumsum(np.r_[0, ~free])
        return np.flatnonzero(taken[n:] == taken[: len(free) - n + 1])

    def common(n: int):
        """(positions in text, their hashes, positions in item, their hashes) of unmarked runs that both sides have."""
        p, q = open_at(free_text, n), open_at(free_item, n)
        hp, hq = rolling(text, n)[p], rolling(item, n)[q]
        hit = np.isin(hp, hq)
        return p[hit], hp[hit], q, hq

    while longest >= m and free_item.any():
        low, high = m - 1, longest  # a match of `low` words exists, or low is m - 1
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(common(n)[0]) else (low, n - 1)
        if low < m:
            break
        p, hp, q, hq = common(low)
        places = defaultdict(list)
        for x, h in zip(q[::-1].tolist(), hq[::-1].tolist(), strict=True):
            places[h].append(x)
        at = 0  # no tile of this walk covers text from here on
        for a, h in zip(p.tolist(), hp.tolist(), strict=True):
            while a >= at and places[h]:
                b = places[h].pop()
                if free_item[b : b + low].all():
                    if np.array_equal(text[a : a + low], item[b : b + low]):
                        free_item[b : b + low] = free_text[a : a + low] = False
                        covered, at = covered + low, a + low
                    break
        longest = low - 1
    return covered


def coverages(doc: np.ndarray, index: Index, seeds: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> dict[int, float]:
    """Coverage of the items that share a seed with the document.

    Items whose seeds could not cover more than the best of those before them, nor `least`
    of their words, are left out: the best one and all of `least` or more are there.
    """
    out, best = {}, 0.0
    there = np.unique(np.concatenate([(at[:, None] + np.arange(m)).ravel() for m, (at, _) in seeds.items()]))
    if not len(there):
        return {}
    gap = np.full(1, -1, np.int64)
    doc = np.concatenate([x for part in np.split(doc[there], np.flatnonzero(np.diff(there) > 1) + 1) for x in (part, gap)])
    for k, most in zip(*index.bounds(seeds), strict=True):
        if most < min(best, least):
            break
        item_id, item = index.items[k]
        share = tile(doc, item, min(index.min_match, len(item))) / len(item)
        if share:
            out[item_id] = max(share, out.get(item_id, 0.0))
            best = max(best, share)
    return out


LEAK = "struct<item_id:bigint,coverage:double,items:array<bigint>>"
_KIND = pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("items", pa.list_(pa.int64()))])


def _told(shares: dict[int, float], threshold: float) -> dict | None:
    if not shares:
        return None
    best = min(shares, key=lambda i: (-shares[i], i))
    return {"item_id": best, "coverage": shares[best], "items": sorted(i for i, s in shares.items() if s >= threshold)}


def _scan(index: Index, threshold: float, text_col: str):
    def run(batches):
        gap = np.full(1, -1, np.int64)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            leaks: list[dict | None] = []
            for low in range(0, b.num_rows, 512):
                numbers = [index.numbers(t.as_py()) for t in texts.slice(low, 512)]
                ids = np.concatenate([x for n in numbers for x in (n, gap)])
                starts = np.cumsum([0] + [len(n) + 1 for n in numbers])
                own: list[dict] = [{} for _ in numbers]
                for m in index.runs:
                    at, h = index.seeds(ids, m)
                    which = np.searchsorted(starts, at, side="right") - 1
                    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]) if len(at) else [0]
                    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                        own[which[a]][m] = (at[a:z] - starts[which[a]], h[a:z])
                leaks += [_told(coverages(n, index, x, threshold), threshold) if x else None for n, x in zip(numbers, own, strict=True)]
            yield b.append_column("leak", pa.array(leaks, _KIND))

    return run


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 1 for w in words), np.int64, len(words))


def _seed_rows(min_match: int, lengths: list[int], filters: dict[int, np.ndarray] | None):
    """(row, seed) of texts; of documents only those in the filter of some length."""

    def run(batches):
        for b in batches:
            rows, seeds = [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = _hashed(words_of(t.as_py()))
                for m in lengths if filters is not None else [min(min_match, len(ids))]:
                    h = np.unique(rolling(ids, m)) if m else np.zeros(0, U)
                    if filters is not None:
                        bit = (h >> U(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
                        h = h[(filters[m][bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                    rows.append(np.full(len(h), row, np.int64)), seeds.append((h ^ U(m)).view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(seeds))], ["row", "seed"])

    return run


def _filters(items: DataFrame, min_match: int) -> dict[int, np.ndarray]:
    """A bit for the upper bits of each seed hash of the items, by the length of the seed."""

    def run(batches):
        for b in batches:
            found = set()
            for t in b.column(0):
                ids = _hashed(words_of(t.as_py()))
                m = min(min_match, len(ids))
                if m:
                    found.update((m, int(x)) for x in (rolling(ids, m) >> U(64 - FILTER_BITS.bit_length() + 1)).tolist())
            m, x = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(x, pa.int64())], ["m", "x"])

    bits = items.select("text").mapInArrow(run, "m int, x long")
    # at most FILTER_BITS / 8 bytes for each of min_match lengths, 4 KB a row
    rows = bits.groupBy("m", F.floor(F.col("x") / 32768).alias("page")).agg(F.bitmap_construct_agg(F.pmod("x", F.lit(32768))).alias("bits")).toLocalIterator()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["m"], np.zeros(FILTER_BITS // 8, np.uint8))[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _tile_rows(min_match: int, threshold: float):
    """The leak of each row, from its text (first) and the texts of the items it shares seeds with."""

    def run(batches):
        now, number, doc, shares = None, {}, None, {}
        for b in batches:
            rows, leaks = [], []
            for row, item_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if item_id is None:
                    if shares:
                        rows.append(now), leaks.append(_told(shares, threshold))
                    now, number, shares = row, {}, {}
                    doc = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)
                    continue
                item = np.array([number.get(w, -2) for w in words_of(text)], np.int64)
                item[item == -2] = -2 - np.arange(np.count_nonzero(item == -2))
                share = tile(doc, item, min(min_match, len(item))) / len(item)
                if share:
                    shares[item_id] = max(share, shares.get(item_id, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(leaks, _KIND)], ["row", "leak"])
        if shares:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_told(shares, threshold)], _KIND)], ["row", "leak"])

    return run


def _scan_joined(docs: DataFrame, items: DataFrame, min_match: int, threshold: float, text_col: str) -> DataFrame:
    """As scan, for a benchmark of any size."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns, (its_row,) = docs.columns, free(docs, "_row")
    docs = stage(docs.withColumn(its_row, F.monotonically_increasing_id()), "numbered")
    items = stage(items.withColumn("_item", F.monotonically_increasing_id()), "items")
    filters = _filters(items, min_match)
    lengths = sorted(filters)
    seeds = items.select("_item", "text").mapInArrow(_seed_rows(min_match, lengths, None), "row long, seed long").select(F.col("row").alias("item"), "seed")
    own = docs.select(its_row, F.col(text_col).alias("text")).mapInArrow(_seed_rows(min_match, lengths, filters), "row long, seed long")
    pairs = stage(own.join(seeds, "seed").select("row", "item").distinct(), "pairs")
    asked = pairs.join(items, F.col("item") == F.col("_item")).select("row", "item_id", "text")
    texts = docs.join(pairs.select(F.col("row").alias(its_row)).distinct(), its_row, "left_semi").select(F.col(its_row).alias("row"), F.lit(None).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    dealt = texts.unionByName(asked).repartition(parts, "row").sortWithinPartitions("row", F.col("item_id").asc_nulls_first())
    leaks = stage(dealt.mapInArrow(_tile_rows(min_match, threshold), f"row long, leak {LEAK}"), "leaks")
    drop(pairs), drop(items)
    return docs.join(leaks.withColumnRenamed("row", its_row), its_row, "left").select(*[f"`{c}`" for c in columns], "leak")


def scan(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """docs with a column leak: (item_id, coverage, items), null where no run is shared.

    item_id is the item covered best (the smallest of equals), items are all with a
    coverage of `threshold` or more.  Null and empty texts share nothing; an item of
    fewer words than min_match has to occur whole, one without words is not tested, and
    rows with a null item_id are left out.  Repeated item ids count with their best
    text.  An empty benchmark leaves all clean.  Repeated documents give equal rows.  A
    column of docs named leak is replaced; others pass through.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    docs = docs.drop("leak")
    if not size:
        return docs.withColumn("leak", F.lit(None).cast(LEAK))
    if size > BLOCK_BYTES:
        return _scan_joined(docs, items, min_match, threshold, text_col)
    index = Index([(r[0], r[1]) for r in items.collect()], min_match)  # at most BLOCK_BYTES
    return docs.mapInArrow(_scan(index, threshold, text_col), widened(docs, f"leak {LEAK}"))
