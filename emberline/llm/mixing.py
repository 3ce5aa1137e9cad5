"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source_size times.  The whole part
is certain; the fractional parts are rounded together: two documents meet, words move
from one to the other at random until one of them is certain, and the other goes on.
A meeting keeps the sum of the expected words, so a source ends at its target but for
one document; the longest meet first.  Chunks of a source do this apart, and their residual
documents meet in a reduction tree.  What the very last document leaves is made up by others
of its chunk that had a chance, longest first, so a source comes near its target even where
one document is a large part of it.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.arrow import free
from emberline.scratch import stage

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
CHUNK_ROWS = 2_048
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"


def pivot(words: list[int], chance: list[float], rng: random.Random) -> tuple[list[int], int, float]:
    """Round chances so that their word-weighted sum stays; (rounded, residual index or -1, its chance)."""
    rounded, at, p = [0] * len(words), -1, 0.0
    for j, q in enumerate(chance):
        if words[j] == 0 or q <= 0.0 or q >= 1.0:
            rounded[j] = int(q >= 1.0)
            continue
        if at < 0:
            at, p = j, q
            continue
        a, b = words[at], words[j]
        up_a, up_b = (1 - p) * a, q * b  # what can move from j to at
        down_a, down_b = p * a, (1 - q) * b
        up, down = min(up_a, up_b), min(down_a, down_b)
        if rng.random() * (up + down) < down:
            p, q = (1.0 if up_a <= up_b else p + up / a), (0.0 if up_b <= up_a else q - up / b)
        else:
            p, q = (0.0 if down_a <= down_b else p - down / a), (1.0 if down_b <= down_a else q + down / b)
        if 0.0 < q < 1.0:
            rounded[at], at, p = int(p >= 1.0), j, q
        else:
            rounded[j] = int(q >= 1.0)
            if not 0.0 < p < 1.0:
                rounded[at], at = int(p >= 1.0), -1
    return rounded, at, p


def made_up(words: list[int], rounded: list[int], over: float, at: int) -> list[int]:
    """The documents to round the other way so that `over` words too many (or few), which the document `at` leaves, come near none; longest first."""
    out = []
    for i in sorted((i for i in range(len(words)) if i != at and words[i]), key=lambda i: (-words[i], i)):
        change = -words[i] if rounded[i] else words[i]
        if abs(over + change) < abs(over):
            out.append(i)
            over += change
    return out


OUT = "doc_id long, unit long, source string, words long, chunk long, chance double, extra int"


def _round_chunk(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["words", "unit", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed}:{level}:{key[0]}:{key[1]}")
        rounded, at, p = pivot(rows["words"].tolist(), rows["chance"].tolist(), rng)
        rows["extra"] = pd.array(rounded, dtype="Int32")
        rows["chunk"] = key[1]
        if at >= 0:
            rows.loc[at, "extra"] = int(rng.random() < p) if last else pd.NA
            rows.loc[at, "chance"] = p
            if last:
                words, extra = rows["words"].tolist(), [int(x) for x in rows["extra"]]
                for i in made_up(words, extra, (extra[at] - p) * words[at], at):
                    rows.loc[i, "extra"] = 1 - extra[i]
        return rows[["doc_id", "unit", "source", "words", "chunk", "chance", "extra"]]

    return run


def source_targets(sizes: DataFrame, weights=WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): shares of the sum by weight.

    Sources are ranked by code point, null last, and the weights repeat along the rank,
    which is counted range by range, so that any number of sources does.
    A target stops at `ceiling` times its source; the level at which the others share the
    excess is found from sums alone, so the driver holds two numbers a round.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = stage(sizes.select("source", "n", "source_size").repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "dealt-sources")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stage(dealt.select("source", "n", "source_size", weight.alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(ceiling)
    level, capped = 0.0, -1
    while True:
        over = F.lit(False) if capped < 0 else cap < F.col("weight") * level
        row = ranked.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if row[2] == capped or not row[1]:
            break
        level, capped = (total - row[0]) / row[1], row[2]
    return ranked.select("source", "n", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, unit, size, source, source_size, target, copies) for each row of docs.

    size is the number of words (null text: 0).  Rows equal in id, source and text form
    one unit and get the same number of copies.  Null ids and sources are values like
    others.  Empty documents and empty tables need no special case: no words, no copies
    beyond the certain ones.  Further columns are not read.  Reruns agree, however the
    rows are partitioned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), unit_key(id_col, text_col, source_col).alias("unit"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"),
    )
    rows = stage(rows, "mix-rows")
    sources = stage(source_targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, ceiling), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(ceiling)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rated = sources.select("source", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("chance"), F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"), "source_size", "target")
    units = rows.groupBy("doc_id", "unit", "source", "size").agg(F.count("*").alias("m"))
    units = units.join(rated.select(F.col("source").alias("s"), "chance", "chunks"), F.col("source").eqNullSafe(F.col("s")))
    waiting = units.select("doc_id", "unit", "source", (F.col("size") * F.col("m")).alias("words"), F.pmod(F.xxhash64("unit", "doc_id"), "chunks").alias("chunk"), "chance")
    widest = rated.agg(F.max("chunks")).first()[0] or 1
    done, level = [], 0
    while True:
        last = widest == 1
        out = stage(waiting.groupBy("source", "chunk").applyInPandas(_round_chunk(seed, level, last), OUT), f"pivot{level}")
        done.append(out.where("extra IS NOT NULL").select("doc_id", "unit", "extra"))
        if last:
            break
        waiting = out.where("extra IS NULL").select("doc_id", "unit", "source", "words", F.floor(F.col("chunk") / FAN_IN).alias("chunk"), "chance")
        widest, level = -(-widest // FAN_IN), level + 1
    decided = done[0]
    for more in done[1:]:
        decided = decided.unionByName(more)
    decided = decided.select(F.col("doc_id").alias("d"), F.col("unit").alias("u"), "extra")
    out = rows.join(decided, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("unit") == F.col("u")))
    out = out.join(rated.select(F.col("source").alias("s"), "base", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "unit", "size", "source", "source_size", "target", (F.col("base") + F.col("extra")).alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies.

    Rows equal in id, source and text are one unit and come equally often each.  Nulls are
    values like others; documents without words and an empty table give no rows beyond
    the certain copies.  Other columns pass through, whatever their names.
    """
    its_id, its_unit, copies, copy = free(docs, "_id", "_unit", "_copies", "_copy")
    chosen = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias(its_id), F.col("unit").alias(its_unit), F.col("copies").alias(copies)).distinct()
    names = {k: options[k] for k in ("id_col", "text_col", "source_col") if k in options}
    same = F.col(names.get("id_col", "doc_id")).cast("long").eqNullSafe(F.col(its_id)) & (unit_key(**names) == F.col(its_unit))
    taken = docs.join(stage(chosen, "copies"), same)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select([F.col(f"`{c}`") for c in docs.columns])


def unit_key(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """The hash that, with the id, names a unit of equal rows."""
    return F.xxhash64(F.col(id_col).cast("long"), source_col, text_col)



