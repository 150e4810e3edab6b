"""N-gram Jaccard join of whole documents: a prefix-tree join of word 5-shingle sets.

Sets. A text is lower-cased (A-Z) and cut into words; its set is its distinct runs of five words (with fewer words the whole
sequence is the one member; without words or text the set is empty and links with nothing). A member is a 64-bit hash.
Documents with equal sets form a class, and one set stands for each class from here on.

Order. All members are ordered by how often their bucket (of 2^23, by hash) occurs in the corpus, rare first in classes of nearly
equal counts, then by hash. Any one order is right; this one puts passages that many documents share last. The classes are an
array of one byte a bucket, from counts that Spark sums over all documents.

Candidates. Two sets that link share a member among the first floor(n / 4) + 1 of each (prefix filter). Sets that share such a
member form a run. A pair is met at a member only where both hold enough from there on: at the first member they share, no more
can be common than the shorter rest of the two, so a pair that links always passes there (positional filter). Runs are compared
in rounds: the first sets of each run, the pivots, against all later ones that lie in another component by then; pivots grow
sixteenfold per round, until each pair of each run has been compared or is known to be connected. So a large group of near copies costs about one comparison per member and pivot, not all pairs, and nothing is capped.

Before two sets are fetched, their profiles are compared: how many members fall into each of 256 classes by hash. The sum of
the smaller counts is at least the overlap, so pairs below the needed overlap are left out without loss.

Volume. What is large goes through shuffles only for the documents that need it. The pairs that met are written first, and only
the profiles of their documents take part. Comparisons fetch compressed texts, a third of the bytes of their sets, and hash them
again where they are compared. Copies leave before members are dealt out: a hashed filter passes all that surely are none.

Comparison. The sets that meet one pivot are cut into packs of bounded size. A pack is a trie, its sets in the global order: a
depth-first walk keeps how much of the shared prefix the pivot holds, so shared prefixes are met once, and a subtree is left
as soon as what is held and the members still to come cannot reach the overlap that 100 * common >= 75 * union needs.

Rows that share a doc_id stand for one document. Rows with a null doc_id have their own n_shingles, link with nothing and have a
null component. Ties and repeated rows need no rule. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.base import components, prepare, stored

N, BUCKET_BITS = 5, 23
BUCKETS, SLICES = 1 << BUCKET_BITS, 64
FILTER_BITS = 23
FULL = b"\xff" * 256
FIRST_PIVOTS, GROWTH, PACK = 2, 16, 256
MEASURED = ["doc_id", "n", "key1", "key2", "profile", "slice", "counts"]
_ODD = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1) for i in range(N + 3)]
# a 64-bit value for each byte, A-Z like a-z; 0 for the six bytes that end a word
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.array([0 if _BLANK[i] else int.from_bytes(hashlib.blake2b(bytes([0, i + 32 if 65 <= i <= 90 else i]), digest_size=8).digest(), "little")
                  for i in range(256)], np.uint64)
AT_ONCE = 1 << 20  # bytes of text hashed in one go


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[N]
    x = (x ^ (x >> np.uint64(29))) * _ODD[N + 1]
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: the sum of its bytes' values, each times an odd number to the power of its place in the word."""
    code = np.frombuffer(data, np.uint8)
    blank = _BLANK[code]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _ODD[N + 2])]))
    held = np.flatnonzero(~blank)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    value = _BYTE[code[held]] * power[held - np.repeat(start, length)]
    return start, _mixed(np.add.reduceat(value, first))


def _cut(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of about AT_ONCE bytes that end behind a blank (or are one long word)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + AT_ONCE)
        while end < len(data) and not _BLANK[data[end - 1]]:
            end += 1
        yield at, data[at:end]
        at = end


def set_of(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of N words (of all words, if fewer)."""
    if not len(h):
        return h
    n = min(N, len(h))
    runs = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        runs = runs * _ODD[i] + h[i:len(h) - n + 1 + i]
    runs = np.sort(_mixed(runs))
    return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]


def member_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of the set of each text; the words of many short texts are hashed together."""
    if not texts:
        return []
    coded = [t.encode() + b"\n" if t else b"\n" for t in texts]
    bounds = np.cumsum([len(c) for c in coded])
    starts, hashes = [], []
    for at, piece in _cut(b"".join(coded)):
        start, h = _word_hashes(piece)
        starts.append(start + at)
        hashes.append(h)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ends = np.searchsorted(np.concatenate(starts), bounds) if hashes else np.zeros(len(texts), np.int64)
    return [set_of(h[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, strict=True)]


def members(text: str | None) -> np.ndarray:
    return member_sets([text])[0]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _profile(h: np.ndarray) -> bytes | None:
    """Members in each of 256 classes; None if a count is too large for its byte (such a set is always compared)."""
    counts = np.bincount((h & np.uint64(255)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n, key1, key2 and profile (of the set) of every row; and, with a slice, how many members fall into each bucket of it.

    The counts are BUCKETS numbers per task, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint8)  # held at 255 in a task: the order needs no more
        for batch in batches:
            sets = member_sets(batch.column("text").to_pylist())
            if not sets:
                continue
            bucket, times = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
            total[bucket] = np.minimum(total[bucket] + times, 255)
            keys = np.frombuffer(b"".join(hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets), np.int64)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array(keys[::2]), pa.array(keys[1::2]),
                 pa.array([_profile(h) for h in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], MEASURED)
        if total.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()),
                 pa.array([zlib.compress(p.tobytes(), 1) for p in total.reshape(SLICES, -1)], pa.binary())], MEASURED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, key1 long, key2 long, profile binary, slice int, counts binary")


def bucket_order(rows: DataFrame) -> np.ndarray:
    """A frequency class for each bucket: about 8 * log2 of its count in all of ``measured``, summed by Spark slice by slice.

    Counts up to eleven have classes of their own, larger ones share a class with counts within a tenth. One byte a
    bucket, so the array has the same size for every corpus.
    """

    def add(tab: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // SLICES, np.int64)
        for c in tab.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
        classes = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
        return pa.table({"slice": tab.column("slice")[:1], "classes": pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())})

    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    parts = rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, classes binary")
    for r in parts.collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return out.ravel()


def _in_order(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return h[np.argsort(rank[_bucket(h)], kind="stable")]  # h is sorted


def prefix_rows(docs: DataFrame, rank, few, through: bool) -> DataFrame:
    """doc_id, n and the prefix of the members in global order, of the documents that the filter ``few`` lets through (or not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            batch = batch.filter(pa.array(few.value[_place(batch.column("doc_id").to_numpy())] == through))
            sets = member_sets(batch.column("text").to_pylist())
            out = [_in_order(h, order)[:len(h) // 4 + 1].view(np.int64) for h in sets]
            at = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n", "members"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(
        run, "doc_id long, n long, members array<long>")


def text_rows(docs: DataFrame, few) -> DataFrame:
    """doc_id and compressed text of the documents that the filter ``few`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(few.value[_place(batch.column("doc_id").to_numpy())]))
            packed = [zlib.compress((t or "").encode(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(
        run, "doc_id long, packed binary")


def profile_rows(rows: DataFrame, few) -> DataFrame:
    """doc_id, n and profile, from ``measured``, of the documents that the filter ``few`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(few.value[_place(batch.column("doc_id").to_numpy())]))

    return rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "profile").mapInArrow(run, "doc_id long, n long, profile binary")


def _place(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A hashed filter of fixed size that lets all ``ids`` (column doc_id) through, and of others the fewer the less it is filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            seen[_place(batch.column("doc_id").to_numpy())] = True
        for i, part in enumerate(seen.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())],
                                                 ["slice", "bits"])

    def unite(tab: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in tab.column("bits")])
        return pa.table({"slice": tab.column("slice")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((SLICES, (1 << FILTER_BITS) // SLICES), bool)
    parts = ids.select("doc_id").mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(unite, "slice int, bits binary")
    for r in parts.collect():
        out[r["slice"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out.ravel()


def ends(pairs: DataFrame) -> np.ndarray:
    """``id_filter`` of both documents of each of the pairs (a, b)."""
    return id_filter(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))


def linked(common: int, a: int, b: int) -> bool:
    return common > 0 and 100 * common >= 75 * (a + b - common)


def trie_walk(pivot: np.ndarray, sets: list[np.ndarray], rank: np.ndarray) -> list[bool]:
    """Which of ``sets`` (members in global order) link with ``pivot``.

    The trie is the sets in lexicographic order of (rank, hash) with the lengths of their common prefixes: each set goes on
    from the place where it leaves the path of the set before it, with the overlap counted up to there.
    """
    def path(h: np.ndarray) -> np.ndarray:
        out = np.empty(len(h), [("r", np.int64), ("h", np.uint64)])
        out["r"], out["h"] = rank[_bucket(h)], h
        return out

    paths = [path(s) for s in sets]
    order = sorted(range(len(sets)), key=lambda i: [x.tobytes() for x in (paths[i]["r"].astype(">i8"), sets[i].astype(">u8"))])
    sorted_pivot, found = np.sort(pivot), [False] * len(sets)
    before, held, known = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0
    for i in order:
        own = sets[i]
        need = -(-75 * (len(own) + len(pivot)) // 175)
        m = min(len(before), len(own), known)
        differ = np.flatnonzero(before[:m] != own[:m])
        shared = int(differ[0]) if len(differ) else m
        counts = np.empty(len(own) + 1, np.int64)
        counts[:shared + 1] = held[:shared + 1]
        at = shared
        while at < len(own) and counts[at] + len(own) - at >= need:  # else no set below this node can reach it with this length
            end = min(len(own), at + 64)
            part = own[at:end]
            place = np.minimum(np.searchsorted(sorted_pivot, part), len(sorted_pivot) - 1)
            counts[at + 1:end + 1] = counts[at] + np.cumsum(sorted_pivot[place] == part)
            at = end
        before, held, known = own, counts, at
        found[i] = at == len(own) and linked(int(counts[at]), len(own), len(pivot))
    return found


def possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose profiles leave room for the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)
            x, y = (np.frombuffer(b"".join(p or FULL for p in side), np.uint8).reshape(-1, 256) for side in zip(*rows, strict=True)
                    ) if len(batch) else (np.zeros((0, 256)), np.zeros((0, 256)))
            room = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            need = 75 * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            unknown = pa.compute.or_(batch.column("pa").is_null(), batch.column("pb").is_null()).to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b"]).filter(pa.array((175 * room >= need) | unknown))

    one = profiles.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    two = profiles.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, rank) -> DataFrame:
    """The pairs (a, b) that link. Each pivot's partners come in packs of about PACK, each a trie of its own."""
    load = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    packed = pairs.join(load, "a").select(F.col("a").alias("pivot"), "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / PACK)).alias("pack"))
    # a pack is its pivot's row and those of the partners
    wanted = packed.select("pivot", "pack", F.col("b").alias("doc_id")).union(
        packed.select("pivot", "pack", F.col("pivot").alias("doc_id")).distinct())

    def walk(tab: pa.Table) -> pa.Table:
        ids, out = tab.column("doc_id").to_pylist(), []
        a = tab.column("pivot")[0].as_py()
        sets = [_in_order(h, rank.value) for h in member_sets([zlib.decompress(x).decode() for x in tab.column("packed").to_pylist()])]
        partners = [(b, h) for b, h in zip(ids, sets, strict=True) if b != a]
        for pivot in (h for b, h in zip(ids, sets, strict=True) if b == a):
            found = trie_walk(pivot, [h for _, h in partners], rank.value)
            out += [b for (b, _), f in zip(partners, found, strict=True) if f]
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return wanted.join(texts, "doc_id").groupBy("pivot", "pack").applyInArrow(walk, "a long, b long").distinct()


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, labels): doc_id, n, key1, key2 of every row, and (node, component) of the documents that link.

    ``node`` is the smallest doc_id of a class of equal sets.
    """
    spark = docs.sparkSession
    prepare(spark)
    all_rows = stored(measured(docs), "ngram-rows")
    rank = spark.sparkContext.broadcast(bucket_order(all_rows))
    rows = all_rows.where("slice is null").select("doc_id", "n", "key1", "key2")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    others = stored(rows.join(classes, ["key1", "key2"]).where("doc_id <> node").select("doc_id").distinct(), "ngram-copies")
    copied = spark.sparkContext.broadcast(id_filter(others))

    def posted(through: bool) -> DataFrame:
        return prefix_rows(docs, rank, copied, through).where("n > 0").select("doc_id", "n", F.posexplode("members").alias("place", "member")).select(
            "member", F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), (F.col("n") - F.col("place")).cast("int").alias("rest"))

    single = posted(False).union(posted(True).join(others.withColumnRenamed("doc_id", "node"), "node", "left_anti").select("member", "node", "n", "rest"))
    run = Window.partitionBy("member")
    numbered = single.withColumn("no", F.row_number().over(run.orderBy("node"))).withColumn("size", F.count("*").over(run)).where("size > 1")
    # the first pivots are met while a run is together, without dealing it out again
    first = numbered.withColumn("heads", F.collect_list(F.when(F.col("no") <= FIRST_PIVOTS, F.struct("node", "n", "rest", "no"))).over(run))
    runs = stored(first.select("member", "node", "n", "rest", "no", "size", F.expr(
        "transform(filter(heads, h -> no > h.no and node <> h.node and 4 * least(n, h.n) >= 3 * greatest(n, h.n)"
        " and 175L * least(rest, h.rest) >= 75L * (n + h.n)), h -> h.node)").alias("met")), "ngram-runs")
    copied.destroy()
    pairs = runs.select(F.explode("met").alias("a"), "node")
    links, labels, done, pivots = None, None, 0, FIRST_PIVOTS
    while True:
        pairs = stored(pairs.select("a", F.col("node").alias("b")).distinct(), "ngram-met")
        if not pairs.isEmpty():
            few = spark.sparkContext.broadcast(ends(pairs))
            pairs = stored(possible(pairs, profile_rows(all_rows, few)), "ngram-pairs")
            few.destroy()
        if not pairs.isEmpty():
            few = spark.sparkContext.broadcast(ends(pairs))
            texts = stored(text_rows(docs, few), "ngram-texts")
            few.destroy()
            new = stored(verified(pairs, texts, rank), "ngram-links")
            if not new.isEmpty():
                links = new if links is None else links.union(new)
                labels = stored(components(links), "ngram-labels")
        done += pivots
        pivots *= GROWTH
        # runs that still hold a set beyond the pivots and sets of more than one component
        named = runs.select("member", "node", "n", "rest", "no", "size").where(F.col("size") > done)
        named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn(
            "label", F.coalesce("component", "node")).drop("component")
        runs = stored(named.withColumn("lo", F.min("label").over(run)).withColumn("hi", F.max("label").over(run)).where(
            "lo <> hi").drop("lo", "hi"), "ngram-runs")
        if runs.isEmpty():
            break
        heads = runs.where((F.col("no") > done) & (F.col("no") <= done + pivots) & (F.col("no") < F.col("size"))).select(
            "member", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("label").alias("la"),
            F.col("no").alias("noa"))
        pairs = runs.where(F.col("no") > done + 1).join(heads, "member").where(
            "no > noa and label <> la and node <> a and 4 * least(n, na) >= 3 * greatest(n, na)"
            " and 175L * least(rest, ra) >= 75L * (n + na)")
    rank.destroy()  # all that needs it is written
    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    return rows, labels


def groups(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id.

    Rows that share a doc_id with different texts are joined under ids of their own, and what they link is united again.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"))
    again = stored(known.groupBy("doc_id").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("doc_id"), "ngram-again")
    return _groups(docs) if again.isEmpty() else _united(docs, again)


def _united(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``groups`` where the doc_ids of ``again`` stand for several texts each: every such text gets 64 bits of a hash as its id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(again.withColumn("several", F.lit(True)), "doc_id", "left")
    rows = stored(own.withColumn("row_id", F.when(F.col("several"), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(F.col("doc_id"))), "ngram-renamed")
    found = stored(_groups(rows.select(F.col("row_id").alias("doc_id"), "text")), "ngram-found")
    each = found.where("doc_id is not null").withColumnRenamed("doc_id", "row_id")
    names = rows.where("row_id is not null").select("row_id", "doc_id").distinct()
    parts = names.join(each.where("n_shingles > 0").select("row_id", F.col("component_id").alias("part")).distinct(), "row_id").select("doc_id", "part").distinct()
    first = parts.groupBy("doc_id").agg(F.min("part").alias("b"))
    joined = components(parts.join(first, "doc_id").select(F.col("part").alias("a"), "b")).withColumnRenamed("node", "part")
    whole = parts.join(joined, "part", "left").select("doc_id", F.coalesce("component", "part").alias("whole"))
    smallest = whole.groupBy("whole").agg(F.min("doc_id").alias("found"))
    named = whole.join(smallest, "whole").select("doc_id", "found").distinct()
    out = each.drop("component_id").join(names, "row_id").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return out.unionByName(found.where("doc_id is null"))


def _groups(docs: DataFrame) -> DataFrame:
    """``groups`` where rows of one doc_id have one text."""
    rows, labels = join(docs)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("node"))
    named = classes.join(labels, "node", "left").select("key1", "key2", F.coalesce("component", "node").alias("found"))
    out = rows.join(named, ["key1", "key2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their component, with the columns of the input; null doc_ids stay."""
    keep = groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi").unionByName(docs.where("doc_id is null"))
