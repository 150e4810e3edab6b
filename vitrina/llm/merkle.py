"""Document fingerprints as Merkle trees over paragraphs and sections.

Paragraphs are lines; a section ends after a blank line or after a paragraph whose digest says so (one in four), so that an
edit moves no later section. Under a paragraph stand leaves: runs of about eight words that end where a word's own checksum
says so, or after 32 words. A digest of a node is that of its children's; the root stands for the whole text exactly (white
space included), so equal texts and only equal texts have equal roots.

A fingerprint is ``root:leaves``: the root in hex and, in base64, four bytes per leaf: 24 bits of its digest, six bits of its
number of words, one bit each for the end of a paragraph and of a section. The inner digests follow from the leaves. Likeness:
1 for equal roots; else sections found on both sides count with all their words, in the others paragraphs, in the others
leaves; twice the common words over the words of both. ``differences`` names the branches that differ.

Null texts are empty. The next document is the next row in order of (doc_id, text), null doc_ids last; after the last comes
the first; a single row is its own next. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.base import prepare

LEAF_MASK, LEAF_MOST, SECTION_MASK = 7, 32, 3
LAST = 9223372036854775807
_WORD = re.compile(r"\S+\s*|\s+")
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
          " near_next double")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaves(paragraph: str) -> Iterator[tuple[str, int]]:
    run, n = [], 0
    for word in _WORD.findall(paragraph):
        run.append(word)
        n += 1
        if n == LEAF_MOST or not zlib.crc32(word.rstrip().encode()) & LEAF_MASK:
            yield "".join(run), n
            run, n = [], 0
    if run:
        yield "".join(run), n


def fingerprint(text: str | None) -> str:
    packed, sections, section = bytearray(), [], []
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        paragraph = line + "\n" if i + 1 < len(lines) else line
        digests = []
        for leaf, n in _leaves(paragraph):
            d = _digest(leaf.encode())
            digests.append(d)
            packed += d[:3] + bytes([n])
        if not digests:
            continue
        d = _digest(b"".join(digests))
        section.append(d)
        packed[-1] |= 0x40
        if not line.strip() or not d[0] & SECTION_MASK or i + 1 == len(lines):
            sections.append(_digest(b"".join(section)))
            section = []
            packed[-1] |= 0x80
    if section:
        sections.append(_digest(b"".join(section)))
    return _digest(b"".join(sections)).hex() + ":" + base64.b64encode(bytes(packed)).decode()


def _tree(print_: str) -> tuple[str, list[list[bytes]]]:
    """Root and sections as lists of paragraphs of a fingerprint, each as the bytes of its leaves."""
    root, _, coded = print_.partition(":")
    data, sections, section, start = base64.b64decode(coded), [], [], 0
    for at in range(3, len(data), 4):
        if data[at] & 0x40:
            section.append(data[start:at + 1])
            start = at + 1
            if data[at] & 0x80:
                sections.append(section)
                section = []
    if section:
        sections.append(section)
    return root, sections


def _words(leaves: bytes) -> int:
    return sum(b & 0x3F for b in leaves[3::4])


def _common(a: list[bytes], b: list[bytes]) -> tuple[int, list[bytes], list[bytes]]:
    """Words of what both lists hold, and what is left of each."""
    ca, cb = Counter(a), Counter(b)
    both = ca & cb
    return sum(_words(x) * n for x, n in both.items()), list((ca - both).elements()), list((cb - both).elements())


def _plain(leaf: bytes) -> bytes:
    return leaf[:3] + bytes([leaf[3] & 0x3F])


def likeness(a: str, b: str) -> float:
    (root_a, tree_a), (root_b, tree_b) = _tree(a), _tree(b)
    if root_a == root_b:
        return 1.0
    total = sum(_words(p) for tree in (tree_a, tree_b) for s in tree for p in s)
    if not total:
        return 0.0
    # a section or paragraph is named by its leaves without the marks of its own end
    ends = {}

    def name(paragraphs: list[bytes]) -> bytes:
        key = b"".join(paragraphs)
        ends[key] = paragraphs
        return key

    common, left_a, left_b = _common([name(s) for s in tree_a], [name(s) for s in tree_b])
    level = [p[:-1] + bytes([p[-1] & 0x7F]) for k in left_a for p in ends[k]], [p[:-1] + bytes([p[-1] & 0x7F]) for k in left_b for p in ends[k]]
    more, left_a, left_b = _common(*level)
    last, _, _ = _common([_plain(p[i:i + 4]) for p in left_a for i in range(0, len(p), 4)],
                         [_plain(p[i:i + 4]) for p in left_b for i in range(0, len(p), 4)])
    return min(1.0, 2 * (common + more + last) / total)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a that b does not hold, found by going down only into sections that differ."""
    (root_a, tree_a), (root_b, tree_b) = _tree(a), _tree(b)
    if root_a == root_b:
        return []
    there = {b"".join(s) for s in tree_b}
    known = {p[:-1] + bytes([p[-1] & 0x7F]) for s in tree_b for p in s}
    return [(i, j) for i, s in enumerate(tree_a) if b"".join(s) not in there
            for j, p in enumerate(s) if p[:-1] + bytes([p[-1] & 0x7F]) not in known]


def _ordered(docs: DataFrame, rows_per_bucket: int) -> DataFrame:
    """doc_id, text, bucket, ahead: the rows in buckets of doc_id ranges; each bucket ends with a copy of the row that follows it.

    Bounds come from quantiles of doc_id alone. The copies are one row for each bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("double"), F.lit(float(LAST))).alias("_at"))
    ids = rows.select("_at")
    buckets = max(1, -(-ids.count() // rows_per_bucket))
    cut = sorted(set(ids.approxQuantile("_at", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    placed = Bucketizer(splits=[-float("inf"), *cut, float("inf")], inputCol="_at", outputCol="bucket").transform(
        rows) if cut else rows.withColumn("bucket", F.lit(0.0))
    first_ids = placed.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"))
    # one number per bucket: the bounds again, as they are met
    heads = placed.join(F.broadcast(first_ids), "bucket").where(F.coalesce("doc_id", F.lit(LAST)) == F.col("first")).groupBy("bucket").agg(
        F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
    order = sorted(r["bucket"] for r in first_ids.collect())
    before = {b: order[i - 1] for i, b in enumerate(order)}
    follow = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    copies = heads.select("doc_id", "text", F.element_at(follow, F.col("bucket")).alias("bucket"), F.lit(True).alias("ahead")) if before else None
    out = placed.select("doc_id", "text", "bucket", F.lit(False).alias("ahead"))
    out = out.unionByName(copies) if copies is not None else out
    return out.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_last(), "text")


def compare(docs: DataFrame, rows_per_bucket: int = 4000) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for doc, text, ahead in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                        batch.column("ahead").to_pylist(), strict=True):
                own = fingerprint(text)
                if last is not None:
                    doc_before, before, print_before = last
                    q = len(before) // 4
                    edited = before[:len(before) - q] + text[:q]
                    print_edited = fingerprint(edited)
                    out.append((doc_before, len(before), hashlib.sha256(edited.encode()).hexdigest(), print_before, print_edited,
                                likeness(print_before, print_edited), likeness(print_before, own)))
                last = None if ahead else (doc, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             [f.split()[0] for f in SCHEMA.split(", ")])

    return _ordered(docs, rows_per_bucket).select("doc_id", "text", "ahead").mapInArrow(run, SCHEMA)
