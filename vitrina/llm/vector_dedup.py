"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors form a class with one representative. k-means centres from a bounded sample (SAMPLE rows) put each
representative into its ``overlap`` nearest clusters; a cluster over LIMIT is dealt into parts of bounded size. In each part
a graph is built: the nearest CANDIDATES of a vector are pruned robustly (a neighbour is left out when one already taken is
closer to it by ALPHA), and the adjacency lists of all parts are united and made symmetric. Search runs part by part: every
vector of a cluster walks the part's graph from the medoids of its connected pieces, always on from the best vectors seen,
and, once in range, on from every vector in range (range-expanding greedy search). Pairs found count only if their cosine in
double precision is at least ``threshold``.

Recall is audited against all pairs of rows drawn by hash (not the rows of the k-means sample's draw) and all vectors: AUDIT
rows at first, more until LINKED of them have links or SAMPLE rows are drawn (a documented bound). It is averaged over vectors
by class of their number of links, so large groups do not speak for small ones. Where a class is below TARGET the overlap
doubles and the search runs again, up to all clusters; if that does not reach it either, all pairs are compared.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id; vectors of
different lengths do not link. Rows that share a vec_id stand for one node. Labels and other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import components, prepare, stored

SAMPLE, CENTRES, CLUSTER, LIMIT = 16384, 2048, 700, 2500
CANDIDATES, DEGREE, ALPHA, BEAM, ROWS = 64, 24, 1.2, 16, 256
AUDIT, TARGET = 200, 0.97
LINKED, CLASS = 200, 10


def unit(column) -> np.ndarray:
    """Rows of an Arrow list column as double-precision unit vectors."""
    x = np.array(column.to_pylist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from the first k rows."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own) and (norm := np.linalg.norm(own.sum(axis=0))) > 0:
                c[j] = own.sum(axis=0) / norm
    return c


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row by robust pruning of its nearest CANDIDATES; all rows at once, one neighbour a round."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    m = min(CANDIDATES, n - 1)
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    rows = np.arange(n)[:, None]
    near = np.take_along_axis(near, np.argsort(-s[rows, near], axis=1, kind="stable"), axis=1)
    away, alive, taken = 1 - s[rows, near], np.ones((n, m), bool), np.zeros((n, m), bool)
    for _ in range(DEGREE):
        first = alive.argmax(axis=1)
        open_ = alive[np.arange(n), first]
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        taken[at, first[at]] = True
        chosen = near[at, first[at]]
        alive[at] &= ALPHA * (1 - s[chosen[:, None], near[at]]) > away[at]
        alive[at, first[at]] = False
    return [near[i][taken[i]] for i in range(n)]


def entries(x: np.ndarray, adjacent: list[np.ndarray]) -> list[int]:
    """The medoid of each connected piece of the graph."""
    piece = np.full(len(x), -1)
    out = []
    for i in range(len(x)):
        if piece[i] >= 0:
            continue
        todo, own = [i], []
        piece[i] = i
        while todo:
            v = todo.pop()
            own.append(v)
            for w in adjacent[v]:
                if piece[w] < 0:
                    piece[w] = i
                    todo.append(w)
        mean = x[own].mean(axis=0)
        out.append(own[int((x[own] @ mean).argmax())])
    return out


def search(queries: np.ndarray, x: np.ndarray, adjacent: list[np.ndarray], starts: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that the walks find within the threshold; a block of queries walks together."""
    wide = max([1, *map(len, adjacent)])
    table = np.full((len(x), wide), -1, np.int64)
    for i, a in enumerate(adjacent):
        table[i, :len(a)] = a
    found_q, found_x = [], []
    for lo in range(0, len(queries), ROWS):
        q = queries[lo:lo + ROWS]
        sim = np.full((len(q), len(x)), -2.0)
        done = np.zeros(sim.shape, bool)
        sim[:, starts] = q @ x[starts].T
        while True:
            waiting = np.where(done, -2.0, sim)
            front = waiting >= threshold - 0.02
            beam = min(BEAM, len(x))
            bar = np.partition(sim, len(x) - beam, axis=1)[:, len(x) - beam]
            best = waiting.argmax(axis=1)
            value = waiting[np.arange(len(q)), best]
            go = np.flatnonzero((value > -2) & (value >= bar))
            front[go, best[go]] = True
            r, v = np.nonzero(front)
            if not len(r):
                break
            done[r, v] = True
            nb = table[v]
            pair = np.unique((r[:, None] * len(x) + nb)[nb >= 0])
            pr, px = pair // len(x), pair % len(x)
            new = sim[pr, px] == -2.0
            pr, px = pr[new], px[new]
            for a in range(0, len(pr), 65536):
                b = slice(a, a + 65536)
                sim[pr[b], px[b]] = np.einsum("ij,ij->i", q[pr[b]], x[px[b]])
        r, v = np.nonzero(sim >= threshold - 1e-9)
        exact = np.einsum("ij,ij->i", q[r], x[v]) >= threshold
        found_q.append(r[exact] + lo)
        found_x.append(v[exact])
    return (np.concatenate(found_q), np.concatenate(found_x)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _good(rows: DataFrame) -> DataFrame:
    """Rows whose vector can link, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    return rows.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _draw(salt: str, bits: int = 30) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), F.lit(1 << bits)) / float(1 << bits)


def links_of(nodes: DataFrame, n: int, dim: int, threshold: float, overlap: int) -> DataFrame:
    """(a, b) both ways: found pairs of the nodes (node, v, all of one length)."""
    spark = nodes.sparkSession
    k = max(1, min(CENTRES, math.ceil(n / CLUSTER)))
    sample = nodes.where(_draw("vectors") < min(1.0, SAMPLE / n)).select("node", "v").collect()
    sample.sort(key=lambda r: hash((r["node"] * 2654435761) % 2**32))
    xs = np.array([r["v"] for r in sample], dtype=np.float64)
    c = centres(xs / np.linalg.norm(xs, axis=1, keepdims=True), min(k, len(xs)))
    shared, o = spark.sparkContext.broadcast(c), min(overlap, len(c))

    def assign(batches):
        for batch in batches:
            near = np.argsort(-(unit(batch.column("v")) @ shared.value.T), axis=1, kind="stable")[:, :o]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("v"), pa.array(near.tolist(), pa.list_(pa.int32()))],
                                             ["node", "v", "near"])

    placed = stored(nodes.select("node", "v").mapInArrow(assign, "node long, v array<double>, near array<int>").select(
        "node", "v", F.explode("near").alias("cluster")), "vector-clusters")
    parts = placed.groupBy("cluster").agg(F.ceil(F.count("*") / LIMIT).alias("parts"))
    dealt = placed.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def build(tab: pa.Table) -> pa.Table:
        node = tab.column("node").to_numpy()
        adjacent = pruned_graph(unit(tab.column("v")))
        a = np.repeat(node, [len(x) for x in adjacent])
        b = node[np.concatenate(adjacent)] if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = dealt.select("cluster", "part", "node", "v").groupBy("cluster", "part").applyInArrow(build, "a long, b long")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    adjacency = both.groupBy("a").agg(F.collect_list("b").alias("adjacent")).withColumnRenamed("a", "node")
    graph = stored(dealt.join(adjacency, "node", "left").select("cluster", "part", "parts", "node", "v", "adjacent"), "vector-graph")
    # every part meets the queries of its whole cluster, in parts as well
    held = graph.select("cluster", "part", "node", "v", "adjacent", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("asked"))
    asked = graph.select(F.col("cluster").alias("qc"), F.col("part").alias("qa"), F.col("node").alias("q"), F.col("v").alias("qv"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("qp"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        node, x = left.column("node").to_numpy(), unit(left.column("v"))
        at = {v: i for i, v in enumerate(node.tolist())}
        adjacent = [np.array([at[b] for b in own or () if b in at], np.int64) for own in left.column("adjacent").to_pylist()]
        q = right.column("q").to_numpy()
        fq, fx = search(unit(right.column("qv")), x, adjacent, entries(x, adjacent), threshold)
        a, b = q[fq], node[fx]
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    found = held.groupBy("cluster", "part", "asked").cogroup(asked.groupBy("qc", "qp", "qa")).applyInArrow(walk, "a long, b long")
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def all_pairs(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) both ways by comparing every part with every other; quadratic."""
    parts = math.ceil(n / LIMIT)
    own = nodes.select(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("own"), "node", "v")
    left = own.select(F.col("own").alias("part"), F.explode(F.sequence("own", F.lit(parts - 1))).alias("asked"), "node", "v")
    right = own.select(F.explode(F.sequence(F.lit(0), "own")).alias("qp"), F.col("own").alias("qa"), F.col("node").alias("q"), F.col("v").alias("qv"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            node, x, q, y = left.column("node").to_numpy(), unit(left.column("v")), right.column("q").to_numpy(), unit(right.column("qv"))
            for lo in range(0, len(q), ROWS):
                i, j = np.nonzero(y[lo:lo + ROWS] @ x.T >= threshold)
                a, b = q[lo + i], node[j]
                found_a.append(a[a != b])
                found_b.append(b[a != b])
        return pa.table({"a": pa.array(np.concatenate(found_a), pa.int64()), "b": pa.array(np.concatenate(found_b), pa.int64())})

    found = left.groupBy("part", "asked").cogroup(right.groupBy("qp", "qa")).applyInArrow(compare, "a long, b long")
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def worst_class(counts: list[tuple[int, int]]) -> float:
    """Lowest mean recall over classes of vectors by their number of links (1, 2 to 3, 4 to 7, ...); counts: (true, found) of each.

    A class of under CLASS vectors joins the next larger one, the largest the one below it.
    """
    classes: dict[int, list[float]] = {}
    for true, hit in counts:
        if true:
            classes.setdefault(true.bit_length(), []).append(hit / true)
    pooled: list[list[float]] = []
    for k in sorted(classes):
        if pooled and len(pooled[-1]) < CLASS:
            pooled[-1] += classes[k]
        else:
            pooled.append(classes[k])
    if len(pooled) > 1 and len(pooled[-1]) < CLASS:
        last = pooled.pop()
        pooled[-1] += last
    return min((sum(p) / len(p) for p in pooled), default=1.0)


def truth_of(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): all true links of about AUDIT nodes by brute force in blocks; of more nodes until LINKED of them have links."""
    spark, size = nodes.sparkSession, AUDIT
    while True:
        rows = nodes.where(_draw("audit") < min(1.0, size / n)).select("node", "v").collect()
        x = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        shared = spark.sparkContext.broadcast((np.array([r["node"] for r in rows], np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)))

        def brute(batches, shared=shared):
            ids, y = shared.value
            for batch in batches:
                node = batch.column("node").to_numpy()
                if len(ids):
                    i, j = np.nonzero(y @ unit(batch.column("v")).T >= threshold)
                    a, b = ids[i], node[j]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], ["a", "b"])

        truth = stored(nodes.select("node", "v").mapInArrow(brute, "a long, b long"), "vector-truth")
        if size >= min(n, SAMPLE) or truth.select("a").distinct().count() >= LINKED:
            return truth
        size *= 4


def audit(truth: DataFrame, links: DataFrame) -> float:
    """The recall of the links, see worst_class."""
    counts = truth.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("a").agg(
        F.count("*").alias("true"), F.count("hit").alias("found"))
    return worst_class([(r["true"], r["found"]) for r in counts.collect()])


def found_links(nodes: DataFrame, threshold: float, overlap: int) -> DataFrame:
    """(a, b) both ways of all nodes (node, v), each length of vectors by itself, with the recall audited."""
    prepare(nodes.sparkSession)
    out = None
    for dim, n in sorted((r["d"], r["n"]) for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()):
        own, wide = nodes.where(F.size("v") == dim), overlap
        truth = truth_of(own, n, threshold)
        while True:
            links = stored(links_of(own, n, dim, threshold, wide), "vector-links")
            if audit(truth, links) >= TARGET:
                break
            if wide >= min(CENTRES, math.ceil(n / CLUSTER)):
                links = stored(all_pairs(own, n, threshold), "vector-links")
                break
            wide *= 2
        out = links if out is None else out.union(links)
    return out


def groups(vectors: DataFrame, threshold: float = 0.9, overlap: int = 3) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = _good(rows)
    classes = good.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stored(classes, "vector-nodes")
    links = found_links(nodes, threshold, overlap)
    size = nodes.groupBy("node").agg(F.sum("copies").alias("copies"))
    if links is None:
        links = rows.sparkSession.createDataFrame([], "a long, b long")
    near = links.join(size.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    named = size.join(near.withColumnRenamed("a", "node"), "node", "left").join(components(links), "node", "left").select(
        F.col("node").alias("_node"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("_links"),
        F.coalesce("component", "node").alias("_component"))
    keyed = good.select("vec_id", F.xxhash64("v").alias("h"), "v").join(nodes.select("v", F.col("node").alias("_node")), "v").select("vec_id", "h", "_node")
    each = keyed.join(named, "_node").groupBy("vec_id", "h").agg(F.max("_links").alias("_links"), F.min("_component").alias("_component"))
    out = rows.withColumn("h", F.xxhash64(F.col("embedding").cast("array<double>"))).join(each, ["vec_id", "h"], "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))
