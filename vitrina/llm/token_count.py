"""Token counts of whole texts; huge documents are encoded in overlapping chunks and resynchronised.

The byte-level BPE first cuts a text into pieces by a pattern, left to right, and never merges across a cut. A chunk that
starts anywhere may cut differently at first, but once both chunks cut at the same place, all further cuts agree, because
the pattern only looks ahead. So a common cut inside the overlap of two chunks, clear of the end of the left one (whose last
pieces could have been longer), is a proven boundary: tokens before it are taken from the left, those after it from the
right. Where no common cut exists (a word or blank run longer than the overlap) the overlap doubles until one appears or the
chunk reaches the end of the text, so the result is always that of the whole text.

The pattern also cuts before every single space between two characters that are not white space, whatever stands around
them. Texts under ``huge`` code points are counted as units between such cuts, and counts of units are remembered, since words repeat; the
memory is cleared when it is full.

Null texts are empty: 0 bytes, 0 tokens. Special strings in a text are tokens, as the library's default. Rows are independent
of each other; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import prepare

MEMORY = 800_000
MARGIN = 64  # more than any special string: a chunk's end cannot hide one that begins before the margin
# where a single space is no certain cut: beside other white space, at either end of the text, beside separators that only
# Python or only the library takes for white space
_UNSURE = re.compile(r"\s | \s|\A | \Z|[\x1c-\x1f]")


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(encoding, start: int) -> list[tuple[int, int]]:
    """(place in the text, tokens before it in this chunk) of every cut of an encoded chunk that starts at ``start``."""
    out, last = [], None
    for i, (word, (begin, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            out.append((start + begin, i))
            last = word
    return out


def resync(tokenizer, text: str, chunk: int = 8192, overlap: int = 512) -> int:
    """Tokens of a text of any length from overlapping chunks; equal to encoding it whole."""
    if chunk <= overlap + 2 * MARGIN:
        raise ValueError("a chunk must be longer than its overlap and margins")
    total, begin, end = 0, 0, min(len(text), chunk)
    left = tokenizer.encode(text[:end], add_special_tokens=False)
    before = 0  # tokens of the left chunk that stand before its proven start
    start = 0
    while end < len(text):
        width, joined = overlap, False
        while not joined:
            # wider on both sides: the right chunk starts earlier, but never before the left one
            begin = max(start, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            right = tokenizer.encode(text[begin:stop], add_special_tokens=False)
            ours = dict(cuts(left, start))
            for place, n in cuts(right, begin):
                if place >= end - MARGIN:
                    break
                if place in ours and place > begin and ours[place] >= before:
                    total += ours[place] - before
                    left, start, before, end, joined = right, begin, n, stop, True
                    break
            if not joined:
                width *= 2
                if begin == start:  # no cut in the whole left chunk: encode it anew, longer
                    end = min(len(text), start + 2 * (end - start))
                    left = tokenizer.encode(text[start:end], add_special_tokens=False)
                    ours = dict(cuts(left, start))
                    if end == len(text):
                        break
    return total + len(left.ids) - before


class Units(dict):
    """Token numbers of units met so far, each with the space before it."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        if unit[-1] in ".," and unit[-2:-1].isalpha():  # always cut between a letter and a mark, which is one token
            n = self[unit[:-1]] + 1
        else:
            n = len(self.tokenizer.encode(" " + unit, add_special_tokens=False))
        self[unit] = n
        return n


class Counter:
    """Counts texts with one tokenizer and a bounded memory of units."""

    def __init__(self, path: str, huge: int, chunk: int, overlap: int):
        self.tokenizer, self.huge, self.chunk, self.overlap = load(path), huge, chunk, overlap
        self.units = Units(self.tokenizer)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) >= self.huge:
            return resync(self.tokenizer, text, self.chunk, self.overlap)
        if _UNSURE.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        first, *rest = text.split(" ")
        return len(self.tokenizer.encode(first, add_special_tokens=False)) + sum(map(self.units.__getitem__, rest))


@lru_cache(maxsize=1)
def shared_counter(path: str, huge: int, chunk: int, overlap: int) -> Counter:
    """One per worker process, kept from task to task."""
    return Counter(path, huge, chunk, overlap)


def counts(docs: DataFrame, path: str | None = None, limit: int = 512, huge: int = 16384, chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    prepare(docs.sparkSession)
    name = path or vocabulary()

    def run(batches):
        counter = shared_counter(name, huge, chunk, overlap)
        for batch in batches:
            found = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
