"""Divergence of sources within a language, from counts of terms in exact integers.

Terms with one sparse vector of counts by source are one: every pair of sources is evaluated
once for each distinct vector and multiplied by the number of its terms.  A vector is worked
on over the sources it has; what a source without the term contributes depends on the counts
of the other source alone, so it comes from that source's distinct counts.  With p0 the share
of an absent term, the sum over all terms for sources s and t is

    V f(p0s, p0t)
    + sum over terms in s of f(ps, p0t) - f(p0s, p0t)
    + sum over terms in t of f(p0s, pt) - f(p0s, p0t)
    + sum over terms in both of f(ps, pt) - f(ps, p0t) - f(p0s, pt) + f(p0s, p0t)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm import terms
from emberline.scratch import drop, stage

SHARE = 1_000_000_000
#: documents of a language that a kept term is in, at least
LEAST_DOCS = 3
#: ranks of terms
TOP_TERMS = 200
#: counts that a task holds before it hands them on
HELD = 400_000
#: pairs that numpy evaluates at once
PAIRS = 1 << 20
TABLE = terms.table(digits=False)


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task, summed as far as memory allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            of = [docs[w] for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(words)), pa.repeat(source, len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(of, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), terms.folded(b.column(2), TABLE), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, known = len(n), set()
            for words in terms.pieces(text):
                n.update(words)
                known.update(words)
            docs.update(known)
            entries += len(n) - before
            if entries >= HELD:
                yield from rows()
                held, entries = {}, 0
    yield from rows()


def share_of(count: Column, size: Column) -> Column:
    """1 + floor(SHARE * (count + 1) / size), in decimals where 64 bits do not hold the product."""
    one_more = count + F.lit(1)
    wide = F.call_function("div", F.lit(SHARE).cast("decimal(10,0)") * one_more.cast("decimal(20,0)"), size.cast("decimal(20,0)"))
    return F.when(count < F.lit(9_000_000_000), F.call_function("div", F.lit(SHARE).cast("long") * one_more, size)).otherwise(wide) + F.lit(1)


def _f(p, q):
    return (p - q) * (p - q) // q


def counts_by_term(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, entries): the kept terms with their sparse counts by source, in order of source."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.struct("source", "n")
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return whole.where(F.col("docs") >= least_docs).select("lang", "term", "total", "entries")


def group_sizes(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, idx, n, v, n_lang, p0) of every group that occurs, with or without kept terms (then n is 0; v, n_lang and p0 are 0 where the language has none)."""
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    of_group = kept.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    joined = known.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    idx = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    p0 = F.when(F.col("v") > 0, share_of(F.lit(0).cast("long"), F.col("n") + F.col("v"))).otherwise(F.lit(0).cast("long"))
    return joined.select("lang", "source", idx.alias("idx"), "n", "v", "n_lang", p0.alias("p0"))


def _absent(batches) -> Iterator[pa.RecordBatch]:
    """What the distinct counts of a source give for all other sources of its language."""
    for b in batches:
        for lang, me, v, held, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
            idx, zero = (np.array([o[c] for o in others], np.int64) for c in ("idx", "p0"))
            if not v or len(idx) < 2:
                continue
            mine = zero[idx == me][0]
            p, m = (np.array([h[c] for h in held or ()], np.int64) for c in ("p", "m"))
            to, back = v * _f(mine, zero) - m.sum() * _f(mine, zero), -m.sum() * _f(zero, mine)
            step = max(1, PAIRS // len(idx))
            for at in range(0, len(p), step):
                some, times = p[at : at + step, None], m[at : at + step, None]
                to += (times * _f(some, zero)).sum(axis=0)
                back += (times * _f(zero, some)).sum(axis=0)
            keep = idx != me
            own = np.full(keep.sum(), me)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, 2 * len(own)), pa.array(np.r_[own, idx[keep]], pa.int32()), pa.array(np.r_[idx[keep], own], pa.int32()), pa.array(np.r_[to[keep], back[keep]])], ["lang", "s", "t", "value"]
            )


def _present(batches) -> Iterator[pa.RecordBatch]:
    """What distinct vectors give for the pairs of sources that both have the term, times their terms."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        lang, m, lists = langs.indices.to_numpy(), b.column(1).to_numpy(), b.column(2)
        starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
        idx, p, p0 = (flat.field(c).to_numpy().astype(np.int64) for c in ("idx", "p", "p0"))
        sizes = np.diff(starts)
        for code in np.unique(lang):
            width = 1 + max((int(idx[starts[i] : starts[i + 1]].max()) for i in np.flatnonzero(lang == code)), default=0)
            keys, sums = [], []
            for k in np.unique(sizes[lang == code]):
                if k < 2:
                    continue
                rows = np.flatnonzero((lang == code) & (sizes == k))
                cut = max(1, PAIRS // (k * k))
                wide = max(1, PAIRS // k) if cut == 1 else k
                for at in range(0, len(rows), cut):
                    some = rows[at : at + cut]
                    place = starts[some][:, None] + np.arange(k)
                    for left in range(0, k, wide):
                        a, c = place[:, left : left + wide, None], place[:, None, :]
                        value = (_f(p[a], p[c]) - _f(p[a], p0[c]) - _f(p0[a], p[c]) + _f(p0[a], p0[c])) * m[some][:, None, None]
                        found, inverse = np.unique((idx[a] * width + idx[c]).ravel(), return_inverse=True)
                        total = np.zeros(len(found), np.int64)
                        np.add.at(total, inverse, value.ravel())
                        keys.append(found), sums.append(total)
            if not keys:
                continue
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, inverse, np.concatenate(sums))
            apart = (found // width != found % width) & (total != 0)
            found, total = found[apart], total[apart]
            yield pa.RecordBatch.from_arrays([pa.repeat(langs.dictionary[int(code)].as_py(), len(found)), pa.array(found // width, pa.int32()), pa.array(found % width, pa.int32()), pa.array(total)], ["lang", "s", "t", "value"])


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    vectors = stage(kept.groupBy("lang", "entries").agg(F.count("*").alias("m")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    known = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "idx", F.col("n").alias("size"), "v", "p0")
    spread = vectors.select("lang", "vid", "m", F.inline("entries"))
    spread = spread.join(known, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    spread = stage(spread.select("lang", "vid", "m", "idx", share_of(F.col("n"), F.col("size") + F.col("v")).alias("p"), "p0"), "spread")
    schema = "lang string, s int, t int, value long"
    whole = spread.groupBy("vid").agg(F.any_value("lang").alias("lang"), F.any_value("m").alias("m"), F.collect_list(F.struct("idx", "p", "p0")).alias("of"))
    both = whole.where(F.size("of") > 1).select("lang", "m", "of").mapInArrow(_present, schema)
    held = spread.groupBy("lang", "idx", "p").agg(F.sum("m").alias("m")).groupBy("lang", "idx").agg(F.collect_list(F.struct("p", "m")).alias("held"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("idx", "p0")).alias("others"))
    one = groups.select("lang", "idx", "v").join(held, ["lang", "idx"], "left").join(others, "lang").select("lang", "idx", "v", "held", "others")
    alone = one.mapInArrow(_absent, schema)
    summed = both.unionByName(alone).groupBy("lang", "s", "t").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    me, other = (groups.select(F.col("lang").alias(f"{a}_lang"), F.col("idx").alias(f"{a}_idx"), F.col("source").alias(b)) for a, b in (("me", "source"), ("it", "item")))
    # languages without kept terms have their pairs too, at 0
    pairs = groups.where("v = 0").select("lang", "source").join(groups.where("v = 0").select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    named = summed.join(me, (F.col("lang") == F.col("me_lang")) & (F.col("s") == F.col("me_idx"))).join(it := other, (F.col("lang") == it["it_lang"]) & (F.col("t") == it["it_idx"]))
    return named.select("lang", "source", "item", "value").unionByName(pairs.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))


def term_values(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more often than its language."""
    known = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("n").alias("size"), "v", "n_lang")
    spread = kept.select("lang", "term", "total", F.inline("entries")).join(known, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    shares = spread.select("lang", "source", F.col("term").alias("item"), share_of(F.col("n"), F.col("size") + F.col("v")).alias("p"), share_of(F.col("total"), F.col("n_lang") + F.col("v")).alias("q"))
    apart = F.col("p") - F.col("q")
    valued = shares.where("p > q").select("lang", "source", "item", F.call_function("div", apart * apart, F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.withColumn("rank", rank).where(F.col("rank") <= top)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occurs.

    Part `pair` has every other source of the language, part `term` the `top` terms by which
    the source differs from its language.  Null text, language and source are ''.  Each row
    of docs is a document, repeated ones too.  A language without kept terms has its pairs at
    value 0, one with a single source no pairs; an empty table gives an empty result.  Equal
    values rank by the UTF-8 bytes of the item.  Further columns are not read.
    """
    kept = stage(counts_by_term(docs, text_col, lang_col, source_col, least_docs), "kept-terms")
    groups = stage(group_sizes(docs, kept, lang_col, source_col), "groups")
    pairs = pair_values(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    found = term_values(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(found)
