"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id. What fills whole windows is cut off as pieces of exactly one window. Of the rests,
one in FILL_SHARE (by its crc) is cut on into pieces of FILL tokens, which even out what whole rests cannot. Rests and fills
are dealt to groups by a hash, so that a group fills about ``group_windows`` windows, and each group is packed by itself: a partial
partition starts with one piece in one of k windows, and the two partial partitions with the largest imbalances merge again
and again with opposing imbalances (fullest window on emptiest), which ends in k windows of nearly equal sums. k starts at the
least possible number and rises by one whenever a window exceeds the capacity. Padding is about half a window per group on
average, so under one part in ``group_windows`` except in tables of a few windows.

A row of the result is a piece: its document's ids [start, start + length), their crc32, and its place in a sequence. Ids
are not shipped through the shuffle; ``token_ids`` gives them again. Null texts are empty: the end id alone. Rows are
numbered by doc_id, so rows that share one are packed separately but are told apart only by their crc. A null doc_id stays
null. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import prepare, stored
from vitrina.llm.token_count import load, vocabulary

WINDOW, END, GROUP_WINDOWS = 4096, 2, 384
_END = END.to_bytes(4, "little")
FILL, FILL_SHARE = 96, 4
MEMORY = 800_000
# white space of Python that the tokenizer does not take for white space
_ODD = re.compile(r"[\x1c-\x1f]")
# lower-case letters that the tokenizer's normalizer leaves as they are and its cutter never cuts between
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CAPITALS = _LETTERS.replace("ß", "").replace("ÿ", "").upper()  # each becomes one of the letters
_PLAIN = re.compile(f"[{_LETTERS}]+")
_CASED = re.compile(f"[{_LETTERS}{_CAPITALS}]+")
# plain letters before marks, where the cutter always cuts; an apostrophe may belong to letters, "<" to a special string
_MARKED = re.compile(f"([{_LETTERS}{_CAPITALS}]+)([!#$%&*+,./:;=?@^_~-]+)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Words(dict):
    """Token ids (the bytes of little-endian 32-bit numbers) of words met so far; the tokenizer drops white space and never
    merges across it.

    A word of plain letters is one piece for the tokenizer, so its model is asked at once, with the piece spelled as the byte
    level spells it; all other words go through the whole tokenizer. A tokenizer of another make always does.
    """

    def __init__(self, path: str):
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = load(path)
        self.model, level = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        probes = [*_LETTERS, *(f"{c}{d}" for c in _LETTERS for d in "aeñst"), "tokenization", _LETTERS]
        self.direct = isinstance(self.model, BPE) and not self.model.dropout and all(
            self._asked(p) == self._encoded(p) == self._encoded(p.upper() if p.upper().lower() == p else p) for p in probes)
        marks = ("!", "...", ",&&&", "-", "_", "@", "://", "?!", "=", "$$")
        self.direct = self.direct and all(
            self._encoded(f"{c}{m}") == self._encoded(c) + self._encoded(m) for c in _LETTERS for m in marks)

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _asked(self, word: str) -> bytes:
        piece = word if word.isascii() else word.translate(self.spelling)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        if self.direct and _PLAIN.fullmatch(word):
            ids = self._asked(word)
        elif self.direct and _CASED.fullmatch(word):
            ids = self[word.lower()]
        elif self.direct and (parts := _MARKED.fullmatch(word)):
            ids = self[parts[1]] + self[parts[2]]
        # always cut between a letter and a mark, if what the tokenizer makes of the letter ends in a letter
        elif word[-1] in ".," and word[-2:-1].isalpha() and normalize("NFC", word[-2]).lower().isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and "<" not in word and word != word.lower():  # the tokenizer knows lower case alone
            ids = self[word.lower()]
        else:
            ids = self._encoded(word)
        self[word] = ids
        return ids


@lru_cache(maxsize=1)
def shared_words(path: str) -> Words:
    """One per worker process, kept from task to task."""
    return Words(path)


def token_ids(text: str | None, words: Words) -> np.ndarray:
    """Ids of a document with its end id."""
    text = text or ""
    ids = words._encoded(text) if _ODD.search(text) else b"".join(map(words.__getitem__, text.split()))
    return np.frombuffer(ids + _END, dtype="<u4")


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of each document: whole windows from its start, then the rest."""
    prepare(docs.sparkSession)
    name = path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared_words(name)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = token_ids(text, words)
                full = len(ids) // window * window
                edges = list(range(0, full + 1, window))
                if full < len(ids):
                    fill = zlib.crc32(ids[full:].tobytes()) % FILL_SHARE == 0
                    edges += [*(range(full + FILL, len(ids), FILL) if fill else ()), len(ids)]
                out += [(doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids)) for a, b in zip(edges, edges[1:], strict=False)]
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in k sets of nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a heap entry: minus the imbalance, a tie-breaker, ascending (sum, members) of the windows that are not empty
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)  # windows of a that are empty; b's fullest go there
        rest = b[:len(b) - free] if free < len(b) else []  # ascending
        moved = b[len(rest):]
        mixed = [(a[i][0] + s, (a[i][1], m)) for i, (s, m) in enumerate(reversed(rest))]
        merged = sorted([*mixed, *a[len(mixed):], *moved], key=lambda x: x[0])
        low = merged[0][0] if len(merged) == k else 0
        heapq.heappush(heap, (low - merged[-1][0], tie, merged))
        tie += 1
    sets = []
    for _, members in heap[0][2]:
        flat, todo = [], [members]
        while todo:
            for x in todo.pop():
                todo.append(x) if isinstance(x, tuple) else flat.append(x)
        sets.append(flat)
    return sets


def windows(sizes: list[int], window: int) -> list[list[int]]:
    """Sets of indexes, each of at most ``window`` in sum; the number of sets rises until all fit."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return sets
        k += 1


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    each = stored(pieces(docs, path, window), "pack-pieces")
    rests = each.where(F.col("length") < window).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, round(rests[0] / (window * group_windows)))

    def one(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        size, group = tab.column("length").to_numpy(), tab.column("group_no")[0].as_py()
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        whole, part = np.flatnonzero(size == window), np.flatnonzero(size < window)
        sequence[whole] = np.arange(len(whole))
        for no, members in enumerate(windows(size[part].tolist(), window) if len(part) else []):
            at = 0
            for i in sorted(members):
                sequence[part[i]], offset[part[i]] = len(whole) + no, at
                at += int(size[part[i]])
        out = tab.drop_columns(["group_no"])
        return out.append_column("sequence_id", pa.array(sequence * groups + group)).append_column("offset", pa.array(offset))

    dealt = each.withColumn("group_no", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group_no").applyInArrow(one, f"{PIECES}, sequence_id long, offset long")
