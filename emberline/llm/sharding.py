"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into source blocks by a keyed hash.  How many rows each block sends to each
shard is drawn exactly: the column sums are the shard sizes, the row sums the block
sizes, and every such matrix has the probability that a uniformly random permutation
gives it.  Each block permutes its rows locally, hands consecutive runs to the shards,
and each shard permutes what it got, so the slots are a uniform permutation.

A local permutation is a rank by a keyed hash.  Ranges of the hash cut a block or a shard
into pieces of bounded size; a piece is ranked by a window, and the counts of the pieces
before it are added, so no task holds a block or a shard.  Repeated rows are one unit with
a count until each copy has a number of its own: a copy's keys depend on the row and that
number alone, never on files, partitions or attempts.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.arrow import free
from emberline.scratch import drop, stage

ROWS_PER_BLOCK = 65_536
#: blocks at most; block times shard entries of the matrix, about
MAX_BLOCKS = 512
MIN_BLOCKS = 16
MAX_ENTRIES = 1 << 20
#: rows that one window ranks, about
PIECE_ROWS = 16_384
#: copies of one row that one task writes out
COPIES = 65_536


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of `draws` items taken without replacement from `total` are among `good`.

    Inversion outwards from the mode, so it takes a number of steps like the deviation.
    """
    low, high = max(0, draws + good - total), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    at_mode = math.exp(_log_choose(good, mode) + _log_choose(total - good, draws - mode) - _log_choose(total, draws))
    left = rng.random() - at_mode
    up = down = at_mode
    i = j = mode
    while left > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (total - good - draws + i + 1))
            i += 1
            left -= up
            if left <= 0:
                return i
        if j > low:
            down *= j * (total - good - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            left -= down
            if left <= 0:
                return j
    return mode


def communication_matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """A random matrix with these row and column sums, as a uniform permutation gives it."""
    left, matrix = list(columns), []
    for n in rows:
        total, out = sum(left), []
        for c, room in enumerate(left):
            take = hypergeometric(rng, room, total, n)
            total -= room
            n -= take
            left[c] -= take
            out.append(take)
        matrix.append(out)
    return matrix


def split_evenly(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def _numbered(units: DataFrame, widest: int) -> DataFrame:
    """units with a column _copy: each as often as its count _m says, in tasks of bounded size."""
    if widest > COPIES:
        runs = units.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / COPIES))))
        runs = runs.repartition(F.col("_run"), *[F.col(c) for c in units.columns])
        low = F.col("_run") * COPIES
        return runs.withColumn("_copy", F.explode(F.sequence(low, F.least(low + COPIES, F.col("_m")) - 1))).drop("_run")
    return units.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))


def _ranked(rows: DataFrame, group: str, key: str, largest: int, tie: list[str]) -> DataFrame:
    """rows with a column _rank: 0, 1, ... within each group, in order of a hash."""
    pieces = max(1, -(-largest // PIECE_ROWS))
    rows = rows.withColumn("_piece", F.floor(F.shiftrightunsigned(key, 33) * pieces / (1 << 31)).cast("int"))
    counts = rows.groupBy(group, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(key, *tie)) - 1
    ranked = rows.withColumn("_rank", rank).join(base, (F.col(group) == F.col("_g")) & (F.col("_piece") == F.col("_p")))
    return ranked.withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_g", "_p", "_base", "_piece")


def place(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(columns of units but _m, _copy, shard, slot): every unit as often as its count _m.

    Shard sizes differ by one row at most, and slots of a shard run from 0 without gaps.
    """
    spark, names = units.sparkSession, [c for c in units.columns if c != "_m"]
    units = stage(units, "shard-units")
    total, widest = units.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.coalesce(F.max("_m"), F.lit(0))).first()
    blocks = max(1, min(MAX_BLOCKS, MAX_ENTRIES // shards, max(MIN_BLOCKS, -(-total // ROWS_PER_BLOCK))))
    rows = _numbered(units, widest)
    hashed = lambda i: F.xxhash64(F.lit(seed + i), *names, "_copy")
    rows = rows.select(*names, "_copy", F.pmod(hashed(0), F.lit(blocks)).cast("int").alias("_block"), hashed(1).alias("_k1"))
    counts = dict(rows.groupBy("_block").count().collect())  # at most MAX_BLOCKS rows
    sizes = split_evenly(total, shards)
    matrix = communication_matrix(random.Random(seed), [counts.get(b, 0) for b in range(blocks)], sizes)
    ends = [[sum(sent[: s + 1]) for s in range(shards)] for sent in matrix]
    # at most MAX_ENTRIES numbers, one list for each block
    plan = F.broadcast(spark.createDataFrame([(b, e) for b, e in enumerate(ends)], "_pb int, _ends array<long>"))
    tie = [*names, "_copy"]
    dealt = _ranked(rows, "_block", "_k1", max(counts.values(), default=0), tie).join(plan, F.col("_block") == F.col("_pb"))
    dealt = stage(dealt.select(*names, "_copy", _place_of(F.col("_rank"), shards).alias("shard"), hashed(2).alias("_k2")), "shard-dealt")
    drop(units)
    out = _ranked(dealt, "shard", "_k2", max(sizes, default=0), tie)
    return out.select(*names, "_copy", "shard", F.col("_rank").cast("long").alias("slot"))


def _place_of(rank: Column, shards: int) -> Column:
    """How many of the ascending numbers _ends are not above rank, by halving."""
    steps = [1 << i for i in reversed(range(shards.bit_length()))]

    def further(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= shards) & (F.get(F.col("_ends"), to - 1) <= rank), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20_260, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs.

    Law `rows`: shard sizes differ by at most one row, and slots of a shard run from 0
    without gaps.  size is the UTF-8 length plus one (null text: 1, checksum of the empty
    text).  Null ids are shuffled like any value.  Rows equal in id and text change
    places freely, so reruns give the same table.  An empty table gives an empty result;
    further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_m"))
    return place(units, shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_docs(docs: DataFrame, shards: int = 8, seed: int = 20_260) -> DataFrame:
    """docs with columns shard and slot (columns of that name are replaced).

    Rows are known by two hashes of all their columns, so rows equal throughout are one
    unit: its copies are placed one by one and take the columns of any of them.  Nulls in
    any column are values like others; an empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    content = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    # a null and the one after it must not hash like the two in the other order
    content = [c for x in content for c in (x.isNull(), x)]
    h1, h2, run, last = free(docs, "_h1", "_h2", "_run", "_last")
    known = docs.withColumns({h1: F.xxhash64(F.lit(1), *content), h2: F.xxhash64(F.lit(2), *content)})
    units = known.groupBy(h1, h2).agg(F.count("*").alias("_m"))
    placed = place(units, shards, seed).select(h1, h2, F.floor(F.col("_copy") / COPIES).alias(run), "shard", "slot")
    placed = stage(placed, "shard-places")
    one = known.dropDuplicates([h1, h2])
    runs = placed.groupBy(h1, h2).agg(F.max(run).alias(last)).where(F.col(last) > 0)
    if not runs.isEmpty():  # rows repeated very often meet their places in several tasks
        one = one.join(runs, [h1, h2], "left").withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)))))
        return one.join(placed, [h1, h2, run]).select(*[f"`{c}`" for c in docs.columns], "shard", "slot")
    return one.join(placed.drop(run), [h1, h2]).select(*[f"`{c}`" for c in docs.columns], "shard", "slot")
