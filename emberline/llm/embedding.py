"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node.  A first graph comes from buckets of random
hyperplanes; then every node brings its neighbours together, those meet each other, and
each keeps the nearest it has met.  A node whose whole list lies over the threshold is
saturated: its list is enlarged to all of its component, which is compared exactly,
block by block, for counts and not for pairs.  Its places are thereby free for nodes of
other components, so a node keeps the nearest of its own component, to find its way, and
the nearest outside, and a component that meets another over the threshold is joined to it
and compared as one.

Rounds go on until the recall is audited as high enough.  Two samples of nodes are compared
with all rows: one drawn from all nodes, one from those whose nearest is near or over the
threshold, no more than a few of a component, so that rare links count and a large group
does not decide.  Recall is the mean, over the audited nodes that have links, of the share
of them that was found.  Below MIN_RECALL after ROUNDS rounds the operator fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.components import components
from emberline.scratch import drop, stage

THRESHOLD = 0.98
NEIGHBOURS = 8
TREES = 4
LEAF = 128
#: nodes of each of the two audited samples, and of one component in the second
AUDIT_NODES = 512
AUDIT_OF_ONE = 4
TARGET_RECALL = 0.98
MIN_RECALL = 0.9
ROUNDS = 16
#: share of new links below which a round was the last, if the recall is good
SETTLED = 0.001
#: members of a centre that meet in one piece
HUB = 512

EDGE = "node long, nbr long, sim double, far boolean"


def _unit(binary: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    """Rows of unit length, in double precision; scaled first, so that no square overflows."""
    flat = np.frombuffer(b"".join(x.as_py() for x in binary), kind).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _edges(node, nbr, sim, far) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(node, np.int64)), pa.array(np.asarray(nbr, np.int64)), pa.array(np.asarray(sim, np.float64)), pa.array(np.asarray(far, bool))], ["node", "nbr", "sim", "far"])


def _nearest(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, far: np.ndarray, k: int):
    """The k nearest of each node in its own component and the k nearest outside, each neighbour once."""
    order = np.lexsort((nbr, -sim, far, node))
    node, nbr, sim, far = node[order], nbr[order], sim[order], far[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (far[1:] != far[:-1])][: len(node)]
    keep = new | np.r_[True, nbr[1:] != nbr[:-1]][: len(node)]
    node, nbr, sim, far, new = node[keep], nbr[keep], sim[keep], far[keep], new[keep]
    first = np.flatnonzero(new)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)]))
    return node[rank < k], nbr[rank < k], sim[rank < k], far[rank < k]


def _merge(k: int):
    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            rows += b.num_rows
            if rows > 1_000_000:
                held = [list(_nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), k))]
                rows = len(held[0][0])
        if held:
            yield _edges(*_nearest(*(np.concatenate(x) for x in zip(*held, strict=True)), k))

    return run


def _groups(batches, keys: list[str]):
    """Column dictionaries of consecutive rows with equal keys, over batch borders."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]) if held else pa.Table.from_batches([b])
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = np.r_[0, np.flatnonzero(change)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, z - a)
        held = t.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _meet(k: int, most: int, keys: list[str], kind):
    """All rows of a group meet; each keeps the `most` nearest of its component in the group and of the others."""

    def run(batches):
        out, rows = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return _edges(*_nearest(*cols, k))

        for t in _groups(batches, keys):
            ids, roots = t["member"].to_numpy(), t["root"].to_numpy()
            if len(ids) < 2:
                continue
            v = _unit(t["vec"].combine_chunks(), t["dim"][0].as_py(), kind)
            for at in range(0, len(ids), HUB):
                s = v[at : at + HUB] @ v.T
                i = np.arange(len(s))
                s[i, at + i] = -2.0
                other = roots[at : at + HUB, None] != roots
                for far in (False, True):
                    if not (other == far).any():
                        continue
                    near = np.where(other == far, s, -2.0)
                    n = min(most, len(ids) - 1)
                    best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                    sim = np.take_along_axis(near, best, 1).ravel()
                    met = sim > -1.5
                    node = np.repeat(ids[at : at + HUB], n)[met]
                    out.append((node, ids[best].ravel()[met], sim[met], np.full(len(node), far)))
                    rows += len(node)
            if rows > 500_000:
                yield flush()
                rows = 0
        if out:
            yield flush()

    return run


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _first_graph(nodes: DataFrame, k: int, seed: int, kind) -> DataFrame:
    """Neighbours within buckets of random hyperplanes; crowded buckets are dealt into leaves at random."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("bits"))

    def sign(batches):
        for b in batches:
            node, label, dims, bits = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
            out = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = _unit(b.column(3).take(pa.array(at)), int(dim), kind)
                for tree in range(TREES):
                    planes = np.random.default_rng([seed, tree, int(dim)]).standard_normal((int(dim), 48))
                    code = ((v @ planes > 0) * (np.arange(48) < np.minimum(bits[at], 48)[:, None])) @ (1 << np.arange(48, dtype=np.int64))
                    out.append((node[at], np.full(len(at), tree), label[at], dims[at], code))
            if out:
                cols = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["member", "tree", "label", "dim", "code"])

    joined = nodes.join(sizes, (nodes.label == sizes.l) & (nodes.dim == sizes.d)).select("node", "label", "dim", "vec", "bits")
    codes = stage(joined.mapInArrow(sign, "member long, tree long, label long, dim long, code long"), "codes")
    key = ["tree", "label", "dim", "code"]
    crowded = stage(codes.groupBy(*key).agg(F.ceil(F.count("*") / LEAF).alias("leaves")).where("leaves > 1"), "crowded")
    leaves = codes.join(crowded, key, "left").withColumn("leaf", F.pmod(F.xxhash64("member", "tree", F.lit(seed)), F.coalesce("leaves", F.lit(1))))
    placed = leaves.select("member", F.xxhash64(*key, "leaf").alias("bucket")).join(nodes.select(F.col("node").alias("n"), "root", "dim", "vec"), F.col("member") == F.col("n")).select("member", "bucket", "root", "dim", "vec")
    dealt = placed.repartition(_parts(nodes), "bucket", "dim").sortWithinPartitions("bucket", "dim", "member")
    out = _kept(dealt.mapInArrow(_meet(k, k, ["bucket", "dim"], kind), EDGE), k)
    drop(codes), drop(crowded)
    return out


def _kept(edges: DataFrame, k: int) -> DataFrame:
    return stage(edges.repartition(_parts(edges), "node").mapInArrow(_merge(k), EDGE), "graph")


def _round(graph: DataFrame, nodes: DataFrame, k: int, kind) -> DataFrame:
    """Neighbours of each node, with those it is a neighbour of, meet at it; at a hub in pieces, dealt anew each round."""
    pairs = graph.select(F.col("node").alias("centre"), F.col("nbr").alias("member")).union(graph.select("nbr", "node")).distinct()
    own = graph.select("node").distinct()
    pairs = stage(pairs.union(own.select("node", "node")), "meetings")
    hubs = stage(pairs.groupBy("centre").agg(F.ceil(F.count("*") / HUB).alias("pieces")).where("pieces > 1").select(F.col("centre").alias("c"), "pieces"), "hubs")
    pieces = pairs.join(hubs, F.col("centre") == F.col("c"), "left").withColumn("piece", F.pmod(F.xxhash64("member", "centre"), F.coalesce("pieces", F.lit(1))))
    near = pieces.select("centre", "piece", "member").join(nodes.select("node", "root", "dim", "vec"), F.col("member") == F.col("node")).select("centre", "piece", "member", "root", "dim", "vec")
    dealt = near.repartition(_parts(nodes), "centre", "piece").sortWithinPartitions("centre", "piece", "member")
    out = _kept(dealt.mapInArrow(_meet(k, max(2, k // 2), ["centre", "piece"], kind), EDGE).union(graph), k)
    drop(pairs), drop(hubs)
    return out


def _rooted(graph: DataFrame, nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with their roots, and edges with whether they leave the component, by the links found so far."""
    known = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
    nodes = nodes.join(known, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("r", "node")).drop("n", "r")
    nodes = stage(nodes, "nodes")
    edges = graph.join(known, F.col("node") == F.col("n"), "left").withColumn("a", F.coalesce("r", "node")).drop("n", "r")
    edges = edges.join(known, F.col("nbr") == F.col("n"), "left").withColumn("b", F.coalesce("r", "nbr"))
    return nodes, stage(edges.select("node", "nbr", "sim", (F.col("a") != F.col("b")).alias("far")), "graph")


def _blocks(nodes: DataFrame, dense: DataFrame, threshold: float, kind) -> DataFrame:
    """(node, links): exact counts within each dense component, in meetings of two blocks."""
    sizes = stage(dense.groupBy("root").agg(F.count("*").alias("m")), "dense-sizes")
    rows = F.least(F.lit(8_192), F.greatest(F.lit(128), F.ceil(F.col("m") / 16)))
    members = dense.join(sizes, "root").select("node", "root", F.ceil(F.col("m") / rows).cast("int").alias("blocks"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = members.select("node", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "own", (F.col("own") == F.col("other")).alias("alone"))
    placed = cells.join(nodes.select(F.col("node").alias("n"), "dim", "vec", "copies"), F.col("node") == F.col("n")).select("cell", "node", "own", "alone", "dim", "vec", "copies")
    dealt = placed.repartition(_parts(nodes), "cell").sortWithinPartitions("cell", "own", "node")

    def run(batches):
        for t in _groups(batches, ["cell"]):
            ids, own, copies = (t[c].to_numpy() for c in ("node", "own", "copies"))
            v = _unit(t["vec"].combine_chunks(), t["dim"][0].as_py(), kind)
            links = np.zeros(len(ids), np.int64)
            alone = t["alone"][0].as_py()
            for at in range(0, len(ids), 512):
                near = v[at : at + 512] @ v.T >= threshold
                near &= (own[at : at + 512, None] == own) if alone else (own[at : at + 512, None] != own)
                i = np.arange(near.shape[0])
                near[i, at + i] = False
                links[at : at + 512] = near @ copies
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["node", "links"])

    return dealt.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _degrees(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, kind) -> tuple[DataFrame, ...]:
    """(node, links) and (node, root) from the edges over the threshold; these edges, and the roots of dense components."""
    over = graph.where(F.col("sim") >= threshold)
    links = stage(over.select("node", "nbr").union(over.select("nbr", "node")).distinct(), "over")
    roots = stage(components(links.select(F.col("node").alias("u"), F.col("nbr").alias("v"))), "roots")
    full = over.groupBy("node").count().where(F.col("count") >= k).select(F.col("node").alias("n"))
    crowded = stage(roots.join(full, roots.node == full.n, "left_semi").select(F.col("root").alias("r")).distinct(), "saturated")
    dense = stage(roots.join(crowded, roots.root == crowded.r, "left_semi"), "dense")
    exact = _blocks(nodes, dense, threshold, kind)
    loose = links.join(dense.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti")
    counted = loose.join(nodes.select(F.col("node").alias("n"), "copies"), F.col("nbr") == F.col("n")).groupBy("node").agg(F.sum("copies").alias("links"))
    out = stage(exact.union(counted), "degrees")
    drop(dense)
    return out, roots, links, crowded


def _gained(graph: DataFrame, roots: DataFrame, links: DataFrame, crowded: DataFrame, threshold: float) -> int:
    """Edges over the threshold that are not known: none within a component that was compared exactly counts."""
    over = graph.where(F.col("sim") >= threshold).select("node", "nbr", "far")
    rooted = over.join(roots.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left").drop("n")
    loose = rooted.join(crowded, F.col("root") == F.col("r"), "left").where("far OR r IS NULL")
    return loose.join(links.select("node", "nbr"), ["node", "nbr"], "left_anti").count()


def _true_degrees(nodes: DataFrame, sample: list, threshold: float, kind) -> dict[int, int]:
    """Links of a bounded sample of nodes, against all rows."""
    by_dim = {}
    for r in sample:
        by_dim.setdefault((r["label"], r["dim"]), []).append((r["node"], bytes(r["vec"])))
    asked = {key: (np.array([n for n, _ in rows]), _unit(pa.array([v for _, v in rows]), key[1], kind)) for key, rows in by_dim.items()}

    def run(batches):
        for b in batches:
            node, label, dims, copies = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
            for key, (ids, queries) in asked.items():
                at = np.flatnonzero((label == key[0]) & (dims == key[1]))
                if len(at):
                    s = queries @ _unit(b.column(3).take(pa.array(at)), key[1], kind).T >= threshold
                    s &= ids[:, None] != node[at]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s @ copies[at])], ["node", "links"])

    rows = nodes.select("node", "label", "dim", "vec", "copies").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()
    return {r["node"]: r["links"] for r in rows}


def _near_sample(graph: DataFrame, nodes: DataFrame, roots: DataFrame, threshold: float, seed: int) -> list:
    """At most AUDIT_NODES nodes whose nearest is near or over the threshold, at most AUDIT_OF_ONE of a component."""
    near = graph.groupBy("node").agg(F.max("sim").alias("best")).where(F.col("best") >= 2 * threshold - 1).select(F.col("node").alias("n"))
    near = near.join(roots.select("node", "root"), F.col("n") == F.col("node"), "left").select("n", F.coalesce("root", "n").alias("root"), F.xxhash64(F.lit(seed), "n").alias("h"))
    # one for each component and lot, by partial aggregates; a lot is drawn by hash
    chosen = near.groupBy("root", F.pmod("h", F.lit(AUDIT_OF_ONE)).alias("lot")).agg(F.min_by("n", "h").alias("n")).select("n")
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed + 1), "n")).limit(AUDIT_NODES)
    return nodes.join(F.broadcast(chosen), F.col("node") == F.col("n")).select("node", "label", "dim", "vec").collect()


def _recall(degrees: DataFrame, truth: dict[int, int]) -> float | None:
    """Mean share of the links that were found, over the audited nodes that have some; None without any."""
    linked = {n: x for n, x in truth.items() if x}
    if not linked:
        return None
    found = {r["node"]: r["links"] for r in degrees.where(F.col("node").isin(list(linked))).collect()}
    return sum(min(found.get(n, 0), x) / x for n, x in linked.items()) / len(linked)


def _packed(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, type]:
    """(vec_id, label, vec) with vec null where it links with nothing, and the type of its components."""
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col(label_col).isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    whole = rows.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(F.col(label_col).cast("string"))
    packed = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("v"), F.coalesce(valid, F.lit(False)).alias("valid"))
    kind = np.float32 if single else np.float64

    def pack(batches):
        for b in batches:
            ok = b.column(3).to_pylist()
            vectors = [np.asarray(v.values.to_numpy(zero_copy_only=False), kind).tobytes() if o else None for v, o in zip(b.column(2), ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary())], ["vec_id", "label", "vec"])

    return packed.mapInArrow(pack, "vec_id long, label long, vec binary"), kind


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for each row of rows.

    Two rows link if their labels are equal and not null, their vectors have one length
    and a cosine of `threshold` or more, in double precision.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and neither do
    rows without label.  Labels may be of any type.  Repeated rows count as vectors of
    their own.  A null id is kept as a row; it names a component only if there is no
    other id.  recall is the audited one, the same in each row, and null where no audited
    node has a link; below MIN_RECALL the operator raises an error instead.  An empty
    table gives an empty result; further columns are not read.
    """
    packed, kind = _packed(rows, id_col, vector_col, label_col)
    node = F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))
    every = stage(packed.withColumn("node", node), "vectors")
    nodes = every.where("node IS NOT NULL").groupBy("node", "label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = stage(nodes.withColumns({"dim": (F.octet_length("vec") / np.dtype(kind).itemsize).cast("long"), "root": F.col("node")}), "nodes")
    truth = _true_degrees(nodes, nodes.select("node", "label", "dim", "vec").orderBy(F.xxhash64(F.lit(seed), "node")).limit(AUDIT_NODES).collect(), threshold, kind)
    first = _first_graph(nodes, k, seed, kind)
    graph = _round(first, nodes, k, kind)
    degrees, roots, links, crowded = _degrees(graph, nodes, k, threshold, kind)
    truth |= _true_degrees(nodes, _near_sample(graph, nodes, roots, threshold, seed), threshold, kind)
    recall = _recall(degrees, truth)
    drop(first)
    for turn in range(ROUNDS):
        nodes, rooted = _rooted(graph, nodes, roots)
        fresh = _first_graph(nodes, k, seed + 1 + turn, kind)
        merged = _kept(rooted.union(fresh), k)
        drop(graph), drop(rooted), drop(fresh)
        graph = _round(merged, nodes, k, kind)
        drop(merged)
        gained = _gained(graph, roots, links, crowded, threshold)
        few = gained <= SETTLED * links.count()
        if gained:
            for old in (degrees, roots, links, crowded):
                drop(old)
            degrees, roots, links, crowded = _degrees(graph, nodes, k, threshold, kind)
            recall = _recall(degrees, truth)
        if few and (recall is None or recall >= TARGET_RECALL):
            break
    if recall is not None and recall < MIN_RECALL:
        raise RuntimeError(f"audited recall of links is {recall:.3f} after {ROUNDS} rounds, below {MIN_RECALL}")
    facts = nodes.select("node", "copies", "least").join(degrees.select(F.col("node").alias("n"), "links"), F.col("node") == F.col("n"), "left").drop("n")
    facts = stage(facts.join(roots.select(F.col("node").alias("n"), F.col("root")), F.col("node") == F.col("n"), "left").select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "facts")
    named = stage(facts.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    facts = stage(facts.join(named, "root").select(F.col("node").alias("n"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id"), "facts")
    out = every.join(facts, F.col("node") == F.col("n"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"), F.lit(recall).cast("double").alias("recall"))
