"""Toxicity by a weighted lexicon.

Texts and lexicon are folded alike: compatibility forms are resolved, marks, accents and invisible characters dropped, letters of
other alphabets that look Latin replaced (``LOOKALIKE``), digits and signs inside words read as the letters they stand for
(``LEET``), i and l taken for one letter, runs of three or more equal letters shortened to one. What is no letter or digit
then separates words.

The lexicon holds beginnings of words and whole words with weights, learned from labelled rows: log odds of toxic against other
documents that hold them, less ``CAREFUL`` standard errors; a longer entry stands beside a shorter one it begins with only if it
weighs clearly more. Exception phrases are an entry's word with a neighbouring word where labelled documents with that pair are
mostly not toxic; such a hit does not count. All entries are found in one pass of an Aho-Corasick automaton over the folded
text; per word the heaviest entry counts. The sum of weights, also divided by the length in words, goes through a logistic
function fitted on the same rows, which gives the score.

Fitting draws about ``toxic`` and ``other`` documents (parameters) of each label by a hash of doc_id over all labelled rows whose
crc32(doc_id as text) mod 5 is not 0; where a doc_id repeats, its smallest text is taken, and the larger of several labels. Null
labels, doc_ids and texts are not learned from. Counting words of the drawn texts is a grouped job; the driver receives entries
of the lexicon (at most ``entries``) and a row of numbers per drawn document. Without labels of both kinds every score is 0.
Null and empty texts have no hit and get the score of a text without one. Rows with a null doc_id are scored and not held out.
Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import prepare, stored
from vitrina.llm.langid import split_bucket

# fixed values: letters and signs that look like a Latin letter, grouped by that letter
LOOKALIKE = {
    "a": "аαɑᴀ", "b": "вьβʙ", "c": "сϲᴄ", "d": "ԁᴅ", "e": "еєεėᴇ℮",
    "f": "ƒ", "g": "ɡց", "h": "һнʜ", "i": "іιıӏĺǀ", "j": "јϳ", "k": "кκᴋ",
    "m": "мᴍ", "n": "ոηɴп", "o": "оοօᴏøσ", "p": "рρ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ",
    "t": "тτᴛ", "u": "սυᴜ", "v": "νѵᴠ", "w": "ԝѡᴡω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

CAREFUL = 1.64
LEAST_WEIGHT = 1.5
LEAST_DOCS = 8
HASHES = 4
SAME = 0.9
BEGIN, LONGEST = 4, 12  # letters of a word's beginning that can be an entry
_MIXED = re.compile(r"[a-z0-9@$!|]*[0-9@$!|][a-z0-9@$!|]*")
_LETTER = re.compile("[a-z]")
_RUN = re.compile(r"(.)\1\1+")


class _Characters(dict):
    """Folded form of every character, found when it is first met."""

    def __init__(self):
        super().__init__({ord(c): latin for latin, alike in LOOKALIKE.items() for c in alike})
        self.update({ord(c): c for c in "0123456789@$!|"})

    def __missing__(self, point: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(point)).lower():
            kind = unicodedata.category(c)
            if kind.startswith("M") or kind == "Cf":
                continue
            out.append(self[ord(c)] if ord(c) != point and ord(c) in self else c if c.isalnum() else " ")
        self[point] = folded = "".join(out).replace("l", "i")
        return folded


_CHARACTERS = _Characters()
_SUBSTITUTE = str.maketrans(LEET)


def _word(found: re.Match) -> str:
    word = found[0]
    if not _LETTER.search(word):
        return " "
    return word.rstrip("@$!|").lstrip("!|").translate(_SUBSTITUTE)


def fold(text: str | None) -> str:
    """Folded words of a text, each with one space before and after it."""
    if not text:
        return " "
    plain = _MIXED.sub(_word, text.lower().translate(_CHARACTERS))
    words = _RUN.sub(r"\1", plain).split()
    return f" {' '.join(words)} " if words else " "


def entries_of(word: str) -> list[str]:
    """Possible lexicon entries for a folded word: its beginnings, and the word itself with the space that ends it."""
    return [f" {word[:n]}" for n in range(BEGIN, min(len(word), LONGEST) + 1)] + ([f" {word} "] if len(word) > 2 else [])


@dataclass
class Lexicon:
    """Entries with weights, exception phrases (pairs of folded words), and the logistic function."""

    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]] = frozenset()
    scale: tuple[float, ...] = (0.0, 0.0, 0.0)  # constant, per log of the sum, per share of the length
    fitted: bool = False
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(place of the space before the word, weight) of every word that an entry matches, exceptions left out."""
        if not self.weights:
            return []
        best: dict[int, float] = {}
        for end, (size, weight) in self.automaton().iter(folded):
            begin = end - size + 1
            if weight > best.get(begin, 0.0):
                best[begin] = weight
        if self.exceptions and best:
            return [(b, w) for b, w in best.items() if not self.exceptions.intersection(pairs(folded, b))]
        return list(best.items())

    def features(self, folded: str) -> tuple[float, float]:
        total = sum(w for _, w in self.hits(folded))
        words = folded.count(" ") - 1
        return float(np.log1p(total)), total / (total + max(words, 1) ** 0.5)

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        total, share = self.features(fold(text))
        z = self.scale[0] + self.scale[1] * total + self.scale[2] * share
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def pairs(folded: str, begin: int) -> list[tuple[str, str]]:
    """(word before, word) and (word, word after) of the word that follows the space at ``begin``."""
    end = folded.index(" ", begin + 1)
    word, out = folded[begin + 1:end], []
    if begin > 0:
        out.append((folded[folded.rindex(" ", 0, begin) + 1:begin], word))
    if end + 1 < len(folded):
        out.append((word, folded[end + 1:folded.index(" ", end + 1)]))
    return out


def chosen(counts: list[tuple[str, float, float]], n_toxic: float, n_other: float) -> dict[str, float]:
    """Weights of the entries worth having among (entry, toxic documents, other documents)."""
    weight = {}
    for entry, a, b in counts:
        value = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1)) - CAREFUL * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= LEAST_DOCS and value >= LEAST_WEIGHT:
            weight[entry] = float(value)
    known, longer = {e: a for e, a, _ in counts}, Counter()
    for entry in weight:
        if not entry.endswith(" "):
            longer[entry[:-1]] = max(longer[entry[:-1]], known[entry])
    # where one longer beginning accounts for nearly all documents, that one is meant
    weight = {e: w for e, w in weight.items() if longer[e] < SAME * known[e]}
    kept: dict[str, float] = {}
    for entry in sorted(weight, key=lambda e: (len(e.rstrip()), len(e), e)):
        shorter = max((kept.get(entry[:n], 0.0) for n in range(BEGIN + 1, len(entry))), default=0.0)
        if weight[entry] > shorter + 1:
            kept[entry] = weight[entry]
    return kept


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the constant is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (w * (y - p)) - shrink @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sample(docs: DataFrame, labels: DataFrame, toxic: int, other: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of the drawn documents, and the share drawn of each label."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(split_bucket() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = stored(known, "toxicity-labels")
    share = {r["toxic"]: min(1.0, (toxic if r["toxic"] else other) / r["count"]) for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # the drawn ids are bounded by the two parameters
    rows = own.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stored(rows, "toxicity-sample"), share


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Rows without copies and most near copies: of the texts with an equal smallest shingle hash, under any of the ``HASHES``
    hash functions, the first by doc_id stays."""
    word = F.split(F.lower("text"), r"\s+")
    shingles = F.when(F.size(word) < 3, F.array(F.lower("text"))).otherwise(
        F.expr("transform(sequence(1, size(word) - 2), i -> concat_ws(' ', slice(word, i, 3)))"))
    keyed = stored(rows.withColumn("word", word).select("doc_id", "toxic", "text", shingles.alias("shingle")).select(
        "doc_id", "toxic", "text", *[F.array_min(F.transform("shingle", lambda x, i=i: F.xxhash64(F.lit(i), x))).alias(f"low{i}") for i in range(HASHES)]),
        "toxicity-keyed")
    for low in [f"low{i}" for i in range(HASHES)]:
        keyed = keyed.join(keyed.groupBy("toxic", low).agg(F.min("doc_id").alias("doc_id")), ["toxic", low, "doc_id"], "semi")
    return keyed.select("doc_id", "text", "toxic")


def _counted(rows: DataFrame, spell, fields: str) -> DataFrame:
    """Number of toxic and of other documents for each value that ``spell(text)`` gives; counted per batch first."""

    def run(batches):
        for batch in batches:
            by = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                by[toxic].update(set(spell(text)))
            if by[0] or by[1]:
                keys = list(by[0] | by[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))]
                    + [pa.array([c[k] for k in keys], pa.int64()) for c in (by[1], by[0])], [*names, "toxic", "other"])

    names = fields.split(",")
    ddl = ", ".join(f"{n} string" for n in names)
    return rows.select("text", "toxic").mapInArrow(run, f"{ddl}, toxic long, other long").groupBy(*names).agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(rows: DataFrame, share: dict[int, float], entries: int = 20_000) -> Lexicon:
    """Lexicon, exception phrases and scale from drawn rows (doc_id, text, toxic)."""
    spark = rows.sparkSession
    rows = stored(distinct_texts(rows), "toxicity-distinct")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Lexicon({})

    def spell(text):
        return [(e,) for word in set(fold(text).split()) for e in entries_of(word)]

    a, b = F.col("toxic"), F.col("other")
    odds = F.log((a + 0.5) / (size[1] + 1)) - F.log((b + 0.5) / (size[0] + 1))
    likely = _counted(rows, spell, "entry").where((a >= LEAST_DOCS) & (odds >= LEAST_WEIGHT)).orderBy(F.desc(odds * F.sqrt(a)), "entry").limit(entries)
    weights = chosen([(r["entry"], r["toxic"], r["other"]) for r in likely.collect()], size[1], size[0])
    plain = Lexicon(weights)
    shared = spark.sparkContext.broadcast(plain)

    def phrases(text):
        folded = fold(text)
        return [p for begin, _ in shared.value.hits(folded) for p in pairs(folded, begin)]

    # a pair of words that is mostly met in documents that are not toxic
    rare = _counted(rows, phrases, "first,second").where((b >= LEAST_DOCS) & (odds <= 0)).orderBy(F.desc("other"), "first", "second").limit(entries)
    lexicon = Lexicon(weights, frozenset((r["first"], r["second"]) for r in rare.collect()))
    shared_lexicon = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        for batch in batches:
            found = [shared_lexicon.value.features(fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])],
                                             ["toxic", "total", "share"])

    seen = rows.select("text", "toxic").mapInArrow(measure, "toxic int, total double, share double").collect()
    y = np.array([r["toxic"] for r in seen], float)
    x = np.array([[r["total"], r["share"]] for r in seen])
    beta = logistic(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return Lexicon(lexicon.weights, lexicon.exceptions, tuple(map(float, beta)), True)


def train(docs: DataFrame, labels: DataFrame, toxic: int = 4000, other: int = 12_000, entries: int = 20_000) -> Lexicon:
    prepare(docs.sparkSession)
    return fit(*sample(docs, labels, toxic, other), entries)


def rated(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame, toxic: int = 4000, other: int = 12_000, entries: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = rated(docs, train(docs, labels, toxic, other, entries))
    return found.select("doc_id", F.coalesce(split_bucket() == 0, F.lit(False)).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
