"""Ranked lexical search with hashed max-sketches.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased. A document's
impact for a term is its term weight times the saturated share of its occurrences, in whole numbers (see ``impacts``). Each
document's impacts fold into a sketch of ``width`` coordinates: a term belongs to the coordinate its hash names, which holds the
largest impact of its terms. The sum of the coordinates that an item's terms name is then never below the item's score, and one
matrix product gives these bounds for a batch of documents and all items. In descending order of their bounds documents are
scored exactly, until the next bound is below the tenth best score met so far in the task; a document whose bound equals it is
still scored, since it may win by its doc_id. Each task gives at most ``k`` rows per item, and a window picks the k best of them.

Items are the stated query set and come in blocks of at most ``BLOCK`` bytes of text (one item at least), read one after the
other from an iterator; a block's terms and weights are broadcast, so what is broadcast is bounded. For each block the documents
are read once: an index row keeps a document's number of terms and, of the block's own terms, which it holds and how often. The
index is written, and both the document frequencies and the search read it.

Null texts and texts without a term have no terms and are not counted in N. Each row of the documents is a document of its own,
also where doc_ids repeat; a null doc_id comes last among equal scores. Items with equal item_id and text are one item; an item
without terms, or a null one, has no results. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.base import prepare, stored

TOP = 10
WIDTH = 2048
BLOCK = 4 << 20
EXACT = 1 << 53  # whole numbers below it are exact in the matrix product
LAST = (1 << 63) - 1  # stands for a null doc_id in comparisons
# terms end at every other ASCII character; A-Z becomes a-z
_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split(b" ") if text else []


def counted(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


@dataclass
class Block:
    """Items of one pass: ids, and per item the numbers of its terms and how often it has each."""

    ids: list[int | None]
    asked: list[tuple[np.ndarray, np.ndarray]]
    number: dict[bytes, int]

    def coordinates(self, width: int) -> np.ndarray:
        return np.array([zlib.crc32(t) % width for t in self.number], np.int64)


def block_of(items: list[tuple[int | None, str]]) -> Block:
    number: dict[bytes, int] = {}
    asked = []
    for _, text in items:
        found = counted(text)
        asked.append((np.array([number.setdefault(t, len(number)) for t in found], np.int64), np.array(list(found.values()), np.int64)))
    return Block([i for i, _ in items], asked, number)


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[Block]:
    held, used = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    for row in rows.toLocalIterator():
        if held and used + len(row["text"]) > size:
            yield block_of(held)
            held, used = [], 0
        held.append((row["item_id"], row["text"]))
        used += len(row["text"])
    if held:
        yield block_of(held)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _index(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms with repeats), held (numbers of the block's terms in the text), tf."""
    shared = docs.sparkSession.sparkContext.broadcast(block.number)

    def run(batches):
        number = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = counted(text)
                if found:
                    own = sorted((number[t], n) for t, n in found.items() if t in number)
                    rows.append((doc_id, found.total(), [i for i, _ in own], [n for _, n in own]))
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["doc_id", "n", "held", "tf"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, held array<int>, tf array<long>")


class Best:
    """The k best (score, smallest doc_id) of one item."""

    def __init__(self, k: int):
        self.k, self.rows = k, []  # (score, -doc_id or -LAST), ascending

    def floor(self) -> int:
        return self.rows[0][0] if len(self.rows) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        if score < self.floor():
            return
        self.rows.append((score, -(LAST if doc_id is None else doc_id)))
        self.rows.sort()
        del self.rows[:-self.k]


class Search:
    """Bounds and exact scores of batches of index rows."""

    def __init__(self, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int, width: int):
        self.weight, self.n_docs, self.n_terms = weight, n_docs, n_terms
        self.asked, self.best = block.asked, [Best(k) for _ in block.ids]
        used, self.place = np.unique(block.coordinates(width), return_inverse=True)  # only coordinates that items name
        self.lookup = np.zeros((len(used), len(block.ids)))
        for i, (own, times) in enumerate(block.asked):
            np.add.at(self.lookup[:, i], self.place[own], times)
        self.heaviest = float(self.lookup.sum(axis=0).max(initial=0))

    def sketches(self, row: np.ndarray, held: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        folded = np.zeros((n, len(self.lookup)))
        np.maximum.at(folded, (row, self.place[held]), impact)
        return folded

    def batch(self, doc_ids: list, n: list[int], held: np.ndarray, tf: np.ndarray, ends: np.ndarray) -> None:
        size = np.diff(ends)
        row = np.repeat(np.arange(len(n)), size)
        m = np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n], np.int64)
        impact = impacts(self.weight[held], tf, m[row])
        bound = self.sketches(row, held, impact, len(n)) @ self.lookup
        if self.heaviest * float(impact.max(initial=0)) >= EXACT:
            bound = bound * (1 + 1e-9) + 1  # the product is rounded: stay above
        own = np.zeros(len(self.weight), np.int64)
        wanted: dict[int, list[int]] = {}
        for i, best in enumerate(self.best):
            near = np.flatnonzero(bound[:, i] >= best.floor())
            for d in near[np.argsort(-bound[near, i], kind="stable")].tolist():
                wanted.setdefault(i, []).append(d)
        for i, docs in wanted.items():
            terms_, times = self.asked[i]
            for d in docs:
                if bound[d, i] < self.best[i].floor():
                    break
                part = slice(ends[d], ends[d + 1])
                own[held[part]] = impact[part]
                self.best[i].offer(int(own[terms_] @ times), doc_ids[d])
                own[held[part]] = 0


def _search(index: DataFrame, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, k: int, width: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches):
        block, weight = shared.value
        search = Search(block, weight, n_docs, n_terms, k, width)
        for batch in batches:
            held, tf = batch.column("held"), batch.column("tf")
            ends = held.offsets.to_numpy()
            search.batch(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), held.flatten().to_numpy(),
                         tf.flatten().to_numpy(), ends - ends[0])
        rows = [(i, None if low == -LAST else -low, score) for i, best in enumerate(search.best) for score, low in best.rows]
        for at in range(0, len(rows), 4096):
            cols = zip(*rows[at:at + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    prepare(spark)
    result = None
    for block in blocks(items, block_bytes):
        index = stored(_index(docs, block), "search-index")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = np.zeros(len(block.number), np.int64)
        for r in index.select(F.explode("held").alias("term")).groupBy("term").count().collect():  # one row per term of the block
            df[r["term"]] = r["count"]
        found = _search(index, block, weights(n_docs, df), n_docs, n_terms, k, width)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        part = stored(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-found")
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if result is None else result


SQL = r"""
WITH word AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
size AS (SELECT rid, doc_id, CAST(count(*) AS BIGINT) AS n FROM word GROUP BY rid, doc_id),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
posting AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM word GROUP BY rid, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, corpus GROUP BY term),
asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
question AS (SELECT item, item_id, term, CAST(count(*) AS BIGINT) AS times FROM asked GROUP BY item, item_id, term),
scored AS (
  SELECT q.item, any_value(q.item_id) AS item_id, p.rid, any_value(s.doc_id) AS doc_id,
         CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * s.n * c.docs) // c.terms)))) AS BIGINT) AS score
  FROM question q JOIN weight w USING (term) JOIN posting p USING (term) JOIN size s ON s.rid = p.rid CROSS JOIN corpus c
  GROUP BY q.item, p.rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
