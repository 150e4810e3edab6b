"""Prefix trie of conversations by a splitter skeleton.

Every conversation becomes a path: one 16-byte digest of (role, text) per turn, so that all conversations with a common
beginning are neighbours in the order of (path, conv_id). That order is cut into shards at splitters drawn from the paths.
A node whose members lie in more than one shard is a prefix of a splitter; the trie of the splitter paths is the skeleton and
is broadcast. Each shard is read once, sorted, with a stack of open nodes: it finishes every node outside the skeleton, and
for the skeleton's nodes it gives partial aggregates, which one grouped reduction combines. A group of equal conversations
holds no shard up, as conv_id is part of the order and splitters fall inside the group.

The skeleton has at most one path per splitter (``SPLITTER`` turns of it) and at most ``SKELETON`` bytes in all: where the
drawn paths are longer, the longest splitters are left out, which makes shards larger and changes no result. What is sent to
the driver is the drawn keys and one row per node of the skeleton.

The conversation ids that end at a node of the skeleton leave the shards as texts of up to ``CHUNK`` ids; their hash needs
them one after the other, so they are streamed in order through one task per node, a batch at a time.

Turns with equal turn number are ordered by role, then by the digest; equal rows are turns of their own. Rows whose conv_id is
null belong to no conversation and are left out. An empty table has no node, not even a root. A conversation's digests are
held in one row (24 bytes a turn). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm.base import prepare, stored

WIDTH = 16  # bytes of a digest
HEAD = 5  # most turns taken from the base conversation
SPLITTER = 256
SKELETON = 32 << 20
CHUNK = 4096
OVERSAMPLE = 20
EMPTY = hashlib.sha256().hexdigest()
RESULT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends_sha256 string")
_LOCAL = pa.schema([
    ("kind", pa.int32()), ("skeleton", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("size", pa.int64()), ("ids", pa.string()),
])
_LOCAL_DDL = ("kind int, skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
              "n_leaves long, saved_tokens long, ends_sha256 string, size long, ids string")
NODE, PART, ENDS = 0, 1, 2


def borrowed(conv_id: F.Column) -> F.Column:
    """Number of turns that a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests one after the other), sizes (code points of each text) of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.char_length(text).alias("size"))
    own = stored(
        conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("t")),
        "trie-turns")
    base = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("t", 1, HEAD).alias("head"))
    joined = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(base, "base", "left").withColumn("h", borrowed(F.col("conv_id")))
    whole = joined.select("conv_id", F.expr("concat(coalesce(slice(head, 1, h), slice(t, 1, 0)), slice(t, h + 1, size(t)))").alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"),
                        F.transform("t", lambda t: t["size"]).alias("sizes"))


def splitters(rows: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` keys (path, conv_id) in ascending order that cut the rows into about equal ranges."""
    if shards < 2:
        return []
    draw = F.pmod(F.xxhash64(F.lit("trie"), "conv_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, OVERSAMPLE * shards / n) * (1 << 30)))
    drawn = rows.where(draw).select(F.substring("path", 1, SPLITTER * WIDTH).alias("path"), "conv_id").collect()
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn)
    cut = sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []
    total, fit = 0, []
    for key in sorted(cut, key=lambda k: len(k[0])):
        total += len(key[0])
        if total <= SKELETON:
            fit.append(key)
    return sorted(fit)


class Skeleton:
    """Trie of the splitter paths; node 0 is the root, and a node's number is larger than its parent's."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.cuts = cuts
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in cuts:
            at = 0
            for i in range(0, len(path), WIDTH):
                step = (at, path[i:i + WIDTH])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(i // WIDTH + 1)
                at = self.child[step]


class Open:
    """A node whose members are still being read."""

    __slots__ = ("skeleton", "size", "convs", "first", "children", "leaves", "saved", "sha", "pending", "ids")

    def __init__(self, skeleton: int | None, size: int):
        self.skeleton, self.size = skeleton, size
        self.convs = self.children = self.leaves = self.saved = 0
        self.first: int | None = None
        self.sha = None  # of the ids that end here, where the node is finished by this shard
        self.pending: list[tuple] = []  # finished children that wait for this node's conv_id
        self.ids: list[int] = []  # that end here, where the node is the skeleton's


class Shard:
    """Stack machine over the rows of one shard in the order of (path, conv_id)."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.out = skeleton, []
        self.path, self.stack = b"", [Open(0, 0)]

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        if path != self.path:
            same, most = 0, min(len(path), len(self.path))
            while same < most and path[same:same + WIDTH] == self.path[same:same + WIDTH]:
                same += WIDTH
            while len(self.stack) > same // WIDTH + 1:
                self.close()
            for i in range(same, len(path), WIDTH):
                above = self.stack[-1].skeleton
                known = None if above is None else self.skeleton.child.get((above, path[i:i + WIDTH]))
                self.stack.append(Open(known, sizes[i // WIDTH]))
            self.path = path
        top = self.stack[-1]
        top.convs += 1
        top.first = conv_id if top.first is None else min(top.first, conv_id)
        if top.skeleton is not None:
            top.ids.append(conv_id)
            if len(top.ids) >= CHUNK:
                self.ends(top)
        elif top.sha is None:
            top.sha = hashlib.sha256(b"%d" % conv_id)
        else:
            top.sha.update(b",%d" % conv_id)

    def ends(self, node: Open) -> None:
        if node.ids:
            self.out.append((ENDS, node.skeleton, node.ids[0], *[None] * 8, ",".join(map(str, node.ids))))
            node.ids = []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.convs += node.convs
            above.first = node.first if above.first is None else min(above.first, node.first)
        if node.skeleton is not None:
            self.ends(node)
            if node.convs:
                self.out.append((PART, node.skeleton, node.first, depth, None, node.convs, node.children, node.leaves, node.saved,
                                 None, node.size, None))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.size
        row = (depth, node.convs, node.children, leaves, saved, node.sha.hexdigest() if node.sha else EMPTY)
        for first, (d, *rest, ends) in node.pending:
            self.out.append((NODE, None, first, d, node.first, *rest, ends, None, None))
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.skeleton is None:
            above.pending.append((node.first, row))
        else:
            d, *rest, ends = row
            self.out.append((NODE, above.skeleton, node.first, d, None, *rest, ends, None, None))

    def finish(self) -> None:
        while self.stack:
            self.close()
        self.path, self.stack = b"", [Open(0, 0)]


def _batches(rows: list[tuple]):
    for i in range(0, len(rows), 4096):
        part = rows[i:i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _LOCAL, strict=True)], schema=_LOCAL)


def _deal(rows: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """The rows with the number of their shard, each shard in one partition and in order."""
    cuts = rows.sparkSession.sparkContext.broadcast(skeleton.cuts)

    def number(batches):
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            found = pa.array([bisect_right(cuts.value, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "shard"])

    return (rows.mapInArrow(number, "conv_id long, path binary, sizes array<int>, shard int")
            .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id"))


def _local(dealt: DataFrame, skeleton: Skeleton) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(skeleton)

    def run(batches):
        shard, at = Shard(shared.value), None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "conv_id"))
            for number, path, sizes, conv_id in zip(*columns, strict=True):
                if number != at:
                    shard.finish()
                    at = number
                shard.add(path, sizes, conv_id)
            yield from _batches(shard.out)
            shard.out = []
        shard.finish()
        yield from _batches(shard.out)

    return dealt.mapInArrow(run, _LOCAL_DDL)


def _ends(chunks: DataFrame) -> DataFrame:
    """skeleton, ends_sha256: each node's ids are hashed in order, batch after batch."""

    def run(batches):
        at, sha = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == at:
                    sha.update(b"," + ids.encode())
                else:
                    if at is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["skeleton", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sha.hexdigest()])], ["skeleton", "ends_sha256"])

    ordered = chunks.select("skeleton", "conv_id", "ids").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    return ordered.select("skeleton", "ids").mapInArrow(run, "skeleton long, ends_sha256 string")


def _finish(spark: SparkSession, skeleton: Skeleton, parts: DataFrame) -> list[tuple]:
    """Rows of the skeleton's nodes: sums of the shards' parts, then sums over the skeleton's own subtrees."""
    reduced = {r["skeleton"]: r for r in parts.groupBy("skeleton").agg(
        F.min("conv_id").alias("first"), F.sum("n_convs").alias("convs"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("size").alias("size")).collect()}
    children = {i: r["children"] for i, r in reduced.items()}
    leaves = {i: r["leaves"] for i, r in reduced.items()}
    saved = {i: r["saved"] + (r["convs"] - 1) * r["size"] for i, r in reduced.items()}
    for i in sorted(reduced, reverse=True):
        leaves[i] = leaves[i] if children[i] else 1
        above = skeleton.parent[i]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    return [(i, r["first"], skeleton.depth[i], reduced[skeleton.parent[i]]["first"] if i else None, r["convs"], children[i], leaves[i], saved[i])
            for i, r in reduced.items()]


def trie(rows: DataFrame, per_shard: int | None = None) -> DataFrame:
    """One row per node of the trie over (conv_id, path, sizes); see ``paths``."""
    spark = rows.sparkSession
    prepare(spark)
    rows = stored(rows, "trie-paths")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    shards = -(-n // (per_shard or max(500, min(100_000, n // 64))))
    skeleton = Skeleton(splitters(rows, shards, n))
    local = stored(_local(_deal(rows, skeleton, len(skeleton.cuts) + 1), skeleton), "trie-local")
    top = spark.createDataFrame(_finish(spark, skeleton, local.where(F.col("kind") == PART)),
                                "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    columns = [c.split()[0] for c in RESULT.split(", ")]
    above = F.broadcast(top.select("skeleton", F.col("conv_id").alias("above")))
    nodes = local.where(F.col("kind") == NODE).join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    upper = top.join(_ends(local.where(F.col("kind") == ENDS)), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return nodes.select(*columns).unionByName(upper.select(*columns))


def nodes(conversations: DataFrame, per_shard: int | None = None) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return trie(paths(conversations), per_shard)


SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS i FROM own),
conv AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, b.i, b.digest, b.text FROM conv c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.digest, t.text FROM conv c JOIN t USING (conv_id) WHERE t.i > c.h),
step AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, length(text) AS size
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
member AS (
  SELECT conv_id, depth, path, substr(path, 1, length(path) - 32) AS above, size FROM step
  UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM conv),
last AS (SELECT conv_id, max(depth) AS depth FROM member GROUP BY conv_id),
node AS (
  SELECT m.path, any_value(m.above) AS above, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.size) AS size,
         coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE l.depth = m.depth), '') AS ends
  FROM member m JOIN last l USING (conv_id) GROUP BY m.path, m.depth),
kids AS (SELECT above AS path, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
under AS (
  SELECT up.path, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM node n LEFT JOIN kids k ON k.path = n.path
  JOIN member up ON up.conv_id = n.conv_id AND up.depth <= n.depth GROUP BY up.path)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id,
       CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN under u USING (path) LEFT JOIN kids k ON k.path = n.path LEFT JOIN node p ON p.path = n.above
"""
