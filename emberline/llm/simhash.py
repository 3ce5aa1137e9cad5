"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so a
range join under it loses no link.  The grid: the segments are dealt into G groups; two
embeddings within distance k agree in G - k groups at least, so both fall into one grid
cell of a table for those groups.  Cell by cell the Manhattan bound is applied and what
remains is verified by the exact Hamming distance.  A cell returns a spanning forest of
its links, never all its pairs; a crowded cell is cut into blocks that meet two by two.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.arrow import free
from emberline.llm.components import components
from emberline.scratch import drop, stage

LOW = 0x5555555555555555
#: rows of one cell that are compared in one piece
CELL_ROWS = 2_048
#: cells that are worked on together
CHUNK_ROWS = 100_000
HASH_SEED = 42
#: bands and least hashes in each: a pair of sets of similarity s shares no key with probability (1 - s**4)**32, at 0.8 5e-8
BANDS, BAND_ROWS = 32, 4
#: cross pairs that a task holds before it hands them on
PAIR_ROWS = 500_000
_SALT, _ODD = np.random.default_rng(HASH_SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def _bit_votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes | None, shingle: int = 4) -> np.ndarray:
    """Hashes of all shingles of a whole text, repeated ones too; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, HASH_SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, out = len(words) - shingle + 1, []
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        out.append(np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, to - at))
    return np.concatenate(out)


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    votes = sum(_bit_votes(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16))
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a whole text; no words give zero."""
    return _majority(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of least hashes of one set; two sets that share a key are compared."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, ((hashes[at : at + (1 << 12)] ^ _SALT[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BAND_ROWS, BANDS):
        key = (key ^ (key >> np.uint64(31))) * _ODD[0] + x
    return key


def fingerprints(docs: DataFrame, shingles: tuple[int, ...] = (4,), id_col: str = "doc_id", text_col: str = "text", banded: bool = False) -> DataFrame:
    """(doc_id, h, fp, fp1, ...): fingerprints as signed longs by shingle length, h a hash of the text.

    With `banded` also size and bands: the size and the band keys of the set of shingles of the first length.
    A null, empty or blank text has fingerprint zero and no bands; ids may be null, and
    every row gives a row.  Further columns are not read.
    """
    names = ["fp", *(f"fp{k}" for k in range(1, len(shingles)))]
    schema = ", ".join(f"{c} long" for c in ("doc_id", "h", *names)) + (", size long, bands array<long>" if banded else "")

    def run(batches):
        for b in batches:
            fps, sizes, bands = np.zeros((len(shingles), b.num_rows), np.uint64), [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for k, n in enumerate(shingles):
                    hashes = shingle_hashes(t, n)
                    fps[k, i] = _majority(hashes)
                    if banded and k == 0:
                        sizes.append(len(np.unique(hashes)))
                        bands.append(band_keys(hashes).view(np.int64) if len(hashes) else [])
            columns = [b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in fps)]
            if banded:
                columns += [pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", *names, *(["size", "bands"] if banded else [])])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return rows.mapInArrow(run, schema)


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, each in its own two bits."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(LOW))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed embeddings: counts 0 and 2 are two apart, all other unequal counts one."""
    x = a ^ b
    odd = x & np.uint64(LOW)
    return np.bitwise_count(odd) + 2 * np.bitwise_count((x >> np.uint64(1)) & ~x & np.uint64(LOW))


def _linked(emb: np.ndarray, fp: np.ndarray, i, j, bits: int) -> np.ndarray:
    near = manhattan(emb[i], emb[j]) <= bits
    return near & (np.bitwise_count(fp[i] ^ fp[j]) <= bits)


def _forest(fp: np.ndarray, bits: int) -> np.ndarray:
    """Root index of each fingerprint of one cell, by a search that visits each once."""
    emb, root, left = embed(fp), np.arange(len(fp)), np.arange(len(fp))
    while len(left):
        start, left = left[0], left[1:]
        front = [start]
        while front and len(left):
            hit = _linked(emb, fp, front.pop(), left, bits)
            if hit.any():
                found, left = left[hit], left[~hit]
                root[found] = start
                front += found.tolist()
    return root


def _forests(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) of consecutive cells; cell: number of the cell of each row."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[first, len(cell)])
    a, b, emb = [], [], embed(fp)
    small = sizes[np.cumsum(np.r_[True, cell[1:] != cell[:-1]]) - 1] <= 16
    for d in range(1, 16):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
        if not len(i):
            break
        i = i[_linked(emb, fp, i, i + d, bits)]
        a.append(fp[i + d]), b.append(fp[i])
    for s, n in zip(first[sizes > 16], sizes[sizes > 16], strict=True):
        part = fp[s : s + n]
        root = _forest(part, bits)
        moved = np.flatnonzero(root != np.arange(n))
        a.append(part[moved]), b.append(part[root[moved]])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _link_cells(bits: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(keep_last: bool):
            t = pa.Table.from_batches(held)
            fp = t["fp"].to_numpy().view(np.uint64)
            ids = [t[c].to_numpy() for c in ("t", "key", "i", "j")]
            change = np.zeros(len(fp), bool)
            for x in ids:
                change[1:] |= x[1:] != x[:-1]
            cut = int(np.flatnonzero(change)[-1]) if keep_last and change.any() else (0 if keep_last else len(fp))
            if not cut:
                return None, t
            a, b = _forests(np.cumsum(change[:cut]), fp[:cut], bits)
            links = np.unique(np.stack([a, b]), axis=1) if len(a) else np.stack([a, b])
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(links)], ["u", "v"]), t.slice(cut)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                out, rest = flush(True)
                held, rows = rest.to_batches(), rest.num_rows
                if out is not None and out.num_rows:
                    yield out
        if held:
            out, _ = flush(False)
            if out is not None:
                yield out

    return run


def grid_masks(groups: int, bits: int) -> list[int]:
    """Masks over the embedding, one for each choice of groups - bits groups of segments."""
    lanes = [0] * groups
    for segment in range(32):
        lanes[segment % groups] |= 3 << (2 * segment)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(lanes[g] for g in chosen)) for chosen in combinations(range(groups), groups - bits)]


def groups_for(n: int, bits: int = 4) -> int:
    """The fewest groups for which a cell of n unrelated fingerprints holds a few on average.

    A segment's count carries about 1.41 bits of collision entropy.  Every choice is exact.
    """
    for groups in range(bits + 2, 2 * bits + 1):
        if n <= 8 * 2 ** (1.41 * 32 * (groups - bits) / groups):
            return groups
    return 2 * bits


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct, not null) within `bits` of each other.

    Links may repeat; without rows there are none.
    """
    masks = grid_masks(groups_for(distinct.count(), bits), bits)
    shifted, low = F.shiftrightunsigned("fp", 1), F.lit(LOW)
    both, one = F.col("fp").bitwiseAND(shifted).bitwiseAND(low), F.col("fp").bitwiseXOR(shifted).bitwiseAND(low)
    emb = F.shiftleft(both, 1).bitwiseOR(one)  # as embed(), in bit operations that cannot overflow
    keys = F.array(*[emb.bitwiseAND(F.lit(m)) for m in masks])
    cells = distinct.select("fp", F.posexplode(keys).alias("t", "key"))
    crowded = cells.groupBy("t", "key").count().where(F.col("count") > CELL_ROWS)
    crowded = stage(crowded.select("t", "key", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("blocks")), "crowded")
    # a cell of b blocks becomes b (b - 1) / 2 meetings of two blocks
    cells = cells.join(crowded, ["t", "key"], "left")
    own = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), "blocks").cast("int")).otherwise(F.lit(0))
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    cells = cells.where("blocks IS NULL OR own <> other")
    cells = cells.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "fp")
    return dealt.mapInArrow(_link_cells(bits), "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp, root, component_id) for each row of docs.

    h is the xxhash64 of the text, root a name of the component that is its own even
    where ids repeat.

    component_id is the smallest id among the documents reachable over fingerprints that
    differ in `bits` bits or fewer.  Null and empty texts have fingerprint zero and are
    linked like others.  Null ids stay as rows and never name a component unless it has
    no other id.  Equal rows give equal rows.  Further columns are not read.
    """
    rows = stage(fingerprints(docs, (shingle,), id_col, text_col), "fp")
    least = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    found = stage(components(links(least.select("fp"), bits)), "fp-roots")
    rooted = stage(least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    named = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    lookup = stage(rooted.join(named, "root").select(F.col("fp").alias("f"), "root", "component_id"), "lookup")
    return rows.join(lookup, rows.fp == lookup.f).select("doc_id", "h", "fp", "root", "component_id")


def _mixed(batches, columns: int):
    """Columns of each key whose rows are of several components; rows come sorted by key and root."""
    held = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cuts = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]]) if len(now[0]) else np.zeros(1, int)
        for i in np.flatnonzero(now[1][cuts[:-1]] != now[1][cuts[1:] - 1]):
            yield [x[cuts[i] : cuts[i + 1]] for x in now[1:]]
        held = [x[cuts[-1] :] for x in now]
    if held is not None and len(held[0]) and held[1][0] != held[1][-1]:
        yield held[1:]


def _within_reach(root: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Which texts of a key meet one of another component there whose size allows the similarity."""
    order = np.argsort(size, kind="stable")
    root, size = root[order], size[order]
    low, high = np.searchsorted(size, similarity * size), np.searchsorted(similarity * size, size, "right")
    turns = np.r_[np.flatnonzero(root[1:] != root[:-1]) + 1, len(root)]
    out = np.zeros(len(root), bool)
    out[order] = turns[np.searchsorted(turns, low, "right")] < high  # sizes low to high are not all of one component
    return out


MEETING = "key long, root long, h long, centre long, centre_root long, fits boolean"


def _meetings(similarity: float):
    """Texts of each key that may be similar to one of another component, and one of them as the centre.

    A key is renamed by the texts it has left, so those of the same texts become one; fits: the
    text is of another component than the centre, and their sizes allow the similarity.
    """

    def run(batches):
        out, rows = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "root", "h", "centre", "centre_root", "fits"])

        for root, h, size in _mixed(batches, 4):
            kept = _within_reach(root, size, similarity)
            n = np.count_nonzero(kept)
            if not n:
                continue
            root, h, size = root[kept], h[kept], size[kept]
            i = np.argmin(h.view(np.uint64) * _ODD[0])
            fits = (root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
            key = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), HASH_SEED)).view(np.int64)
            out.append((np.full(n, key), root, h, np.full(n, h[i]), np.full(n, root[i]), fits))
            rows += n
            if rows > PAIR_ROWS:
                yield flush()
                rows = 0
        if out:
            yield flush()

    return run


#: bits of a filter that spares rows a shuffle
FILTER_BITS = 1 << 24


def _marked(rows: DataFrame, by: Column, asked: DataFrame, its: Column, mark: str) -> DataFrame:
    """rows with a boolean: true for every row whose hash `by` is one of asked's `its`, and for few others.

    The filter has a bounded size; where more is asked than it holds, it marks too much, never too little.
    """
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), place(h).bitwiseAND(F.lit(63)).cast("int"))
    word, bits = free(rows, "_word", "_bits")
    words = asked.groupBy(F.shiftright(place(its), 6).alias(word)).agg(F.bit_or(bit(its)).alias(bits))
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(by)) != 0, F.lit(False))
    return rows.join(F.broadcast(words), F.shiftright(place(by), 6) == F.col(word), "left").withColumn(mark, hit).drop(word, bits)


#: texts of a block of a crowded key
MET_ROWS = 4_096


def _rare_first(flat: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, number of its owners) of the entries by which sets can find each other, in order of owner.

    Two sets of that similarity share one of the first n - ceil(similarity n) + 1 entries
    of each in any one order of all entries; in order of rarity these are in few sets.
    """
    tokens, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(len(size)), size), counts[inverse]
    order = np.lexsort((inverse, often, owner))
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    # the tolerance keeps an exact bound exact
    early = rank < np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, size)
    kept = order[early & (often[order] > 1)]
    return owner[kept], inverse[kept], counts


def _all_met(similarity: float):
    """Links of components by the sets of a key, whole sets against those that share a rare entry with them."""

    def run(batches):
        for root, packed in _mixed(batches, 3):
            sets = [np.frombuffer(x, np.uint64) for x in packed]
            size = np.array([len(x) for x in sets], np.int64)
            flat, first = np.concatenate(sets), np.r_[0, np.cumsum(size)[:-1]]
            owner, token, _ = _rare_first(flat, size, similarity)
            by_token = np.argsort(token, kind="stable")
            lists, at = owner[by_token], np.searchsorted(token[by_token], np.arange(token.max() + 2 if len(token) else 1))
            starts = np.searchsorted(owner, np.arange(len(sets) + 1))
            names, now, counts = np.unique(root, return_inverse=True, return_counts=True)
            links = []
            for i in np.flatnonzero(root != names[counts.argmax()]):  # each pair has an end outside the largest
                mine = token[starts[i] : starts[i + 1]]
                found = np.unique(np.concatenate([lists[at[k] : at[k + 1]] for k in mine])) if len(mine) else mine
                if not len(sets[i]):  # sets without entries are alike
                    found = np.flatnonzero(size == 0)
                # what is linked in this key already need not be compared again
                found = found[(now[found] != now[i]) & (np.minimum(size[found], size[i]) >= similarity * np.maximum(size[found], size[i]))]
                if not len(found):
                    continue
                common = np.zeros(len(found), np.int64)
                if size[i]:
                    ends = np.cumsum(size[found])
                    entries = flat[np.arange(ends[-1]) + np.repeat(first[found] - (ends - size[found]), size[found])]
                    hit = sets[i][np.minimum(np.searchsorted(sets[i], entries), size[i] - 1)] == entries
                    common = np.add.reduceat(hit, ends - size[found], dtype=np.int64)
                for other in found[common >= similarity * (size[i] + size[found] - common)]:
                    if now[other] != now[i]:
                        links.append((int(root[i]), int(root[other])))
                        now[now == now[other]] = now[i]
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _in_blocks(left: DataFrame) -> DataFrame:
    """left (key, root, h) with a key for each two blocks of a crowded key, which hold MET_ROWS texts each."""
    crowded = left.groupBy("key").count().where(F.col("count") > 2 * MET_ROWS)
    crowded = stage(crowded.select("key", F.ceil(F.col("count") / MET_ROWS).cast("int").alias("blocks")), "crowded")
    own = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("h"), "blocks").cast("int")).otherwise(F.lit(0))
    placed = left.join(crowded, "key", "left").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))).where("blocks IS NULL OR own <> other")
    meeting = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return placed.select(meeting.alias("key"), "root", "h")


def _packed_sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["h", "shingles"])

    return run


def _verified(shingle: int, similarity: float):
    """Links of components by pairs of similar texts; the row of u itself comes before its pairs."""

    def run(batches):
        mine = None
        for b in batches:
            out = []
            for u, v, ru, rv, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                its = np.unique(shingle_hashes(text, shingle))
                if u == v:
                    mine = its
                elif min(len(mine), len(its)) >= similarity * max(len(mine), len(its)):
                    common = len(np.intersect1d(mine, its, assume_unique=True))
                    if common >= similarity * (len(mine) + len(its) - common):
                        out.append((ru, rv))
            a, z = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["u", "v"])

    return run


def similar_components(rooted: DataFrame, docs: DataFrame, shingle: int, similarity: float, text_col: str = "text") -> DataFrame:
    """(node, root): wider components of those of rooted (h, root, size, bands).

    The texts of a key first meet one of them, so that a large group becomes one component
    by few pairs; where others are still apart, all of them meet within the key: texts
    that share a rare shingle are compared, in blocks of bounded size.  Keys of the same
    texts are one key, and only texts of keys with several components are moved.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.xxhash64(text_col).alias("h"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    keys = rooted.dropDuplicates(["h"]).select(F.explode("bands").alias("key"), "root", "h", "size")
    met = keys.repartition(parts, "key").sortWithinPartitions("key", "root", "h")
    keys = stage(met.mapInArrow(_meetings(similarity), MEETING).distinct(), "keys")
    pairs = stage(keys.where("fits").select(F.col("centre").alias("u"), F.col("centre_root").alias("ru"), F.col("h").alias("v"), F.col("root").alias("rv")).distinct(), "candidates")
    asked = stage(keys.select("h").distinct(), "asked")
    few = _marked(every, F.col("h"), asked.select(F.col("h").alias("asked")), F.col("asked"), "mark").where("mark").select("h", "text")
    texts = stage(few.join(asked, "h", "left_semi").dropDuplicates(["h"]), "candidate-texts")
    drop(asked)
    own = pairs.select("u", F.col("u").alias("v"), "ru", F.col("ru").alias("rv")).distinct()
    rows = pairs.select("u", "v", "ru", "rv").union(own)
    dealt = rows.join(texts, F.col("v") == F.col("h")).select("u", "v", "ru", "rv", "text").repartition(parts, "u").sortWithinPartitions("u", F.col("u") != F.col("v"))
    star = stage(dealt.mapInArrow(_verified(shingle, similarity), "u long, v long").distinct(), "similar")
    drop(pairs)

    roots = stage(components(star), "star-roots").withColumnRenamed("root", "wider")
    # the centre of a key has met all others
    others = keys.where("h <> centre")
    moved = others.join(roots, others.root == roots.node, "left").select("key", F.coalesce("wider", "root").alias("root"), "h")
    apart = moved.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = stage(moved.join(apart, "key", "left_semi"), "keys")
    drop(keys)
    left = stage(_in_blocks(left), "keys")
    sets = stage(texts.join(left.select("h").distinct(), "h", "left_semi").mapInArrow(_packed_sets(shingle), "h long, shingles binary"), "candidate-sets")
    met = left.join(sets, "h").select("key", "root", "shingles").repartition(parts, "key").sortWithinPartitions("key", "root")
    rest = stage(met.mapInArrow(_all_met(similarity), "u long, v long").distinct(), "similar")
    drop(left), drop(sets), drop(texts)
    return stage(components(star.unionByName(rest)), "similar-roots")


def groups(docs: DataFrame, bits: int = 4, shingles: tuple[int, ...] = (5, 4), id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, h, root): documents that are linked over any of several shingle lengths.

    A fingerprint of each length is a node; the nodes of one document are linked, and
    those of one length within `bits` of each other.  With `similarity`, so are documents
    whose sets of shingles of the first length have that Jaccard similarity or more:
    band keys propose the pairs, and each is decided on the whole sets.  Texts without
    words are alike by their fingerprints.  Null ids stay as rows, repeated rows are in
    one group, and an empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, shingles, id_col, text_col, similarity is not None), "fps")
    node = lambda k, c: F.xxhash64(F.lit(k), c)
    names = ["fp", *(f"fp{k}" for k in range(1, len(shingles)))]
    edges = None
    for k, name in enumerate(names):
        near = links(stage(rows.select(F.col(name).alias("fp")).distinct(), "distinct-fp"), bits).select(node(k, "u").alias("u"), node(k, "v").alias("v"))
        own = rows.select(node(0, "fp").alias("u"), node(k, name).alias("v")).distinct() if k else near
        edges = near if edges is None else edges.unionByName(near).unionByName(own)
    found = stage(components(edges), "fp-roots")
    named = rows.withColumn("first_node", node(0, "fp"))
    rooted = named.join(found, named.first_node == found.node, "left").withColumn("root", F.coalesce("root", "first_node"))
    if similarity is None:
        return rooted.select("doc_id", "h", "root")
    rooted = stage(rooted.select("doc_id", "h", "root", "size", "bands"), "rooted")
    drop(rows)
    joined = similar_components(rooted, docs, shingles[0], similarity, text_col).withColumnRenamed("root", "wider")
    return rooted.join(joined, rooted.root == joined.node, "left").select("doc_id", "h", F.coalesce("wider", "root").alias("root"))


def keep_one(docs: DataFrame, bits: int = 4, shingles: tuple[int, ...] = (5, 4), id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """docs with one row of each group: that with the smallest id, nulls last.

    Of rows with one id the smallest text hash decides, and of equal rows one stays.
    """
    found = stage(groups(docs, bits, shingles, id_col, text_col, similarity), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first")
    its_id, its_hash = free(docs, "_id", "_h")
    chosen = found.groupBy("root").agg(first).select(F.col("first.doc_id").alias(its_id), F.col("first.h").alias(its_hash))
    chosen = stage(chosen.distinct(), "chosen")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(its_id)) & (F.xxhash64(text_col) == F.col(its_hash))
    # rows that are surely not left out stay where they are, only others are moved to be looked up
    out = found.select("doc_id", "h").distinct().join(chosen, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col("h") == F.col(its_hash)), "left_anti")
    out = stage(out.select(F.xxhash64("doc_id", "h").alias("left_out")), "left-out")
    mark, its = *free(docs, "_mark"), F.col("left_out")
    marked = _marked(docs, F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)), out, its, mark)
    kept = marked.where(~F.col(mark)).drop(mark).unionByName(marked.where(mark).drop(mark).join(chosen, same, "left_semi"))
    repeated = found.groupBy("doc_id", "h").count().where("count > 1").join(chosen, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col("h") == F.col(its_hash)), "left_semi")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
