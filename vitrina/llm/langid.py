"""Language identification with string kernels.

Kernel: blended spectrum of character n-grams, presence only. Two texts compare by the number of distinct n-grams
(orders 1 to 3) they share, over the geometric mean of their own numbers. Landmark texts give the Nystrom map, kernel
ridge regression one-versus-rest gives a weight per landmark and language, and texts are scored by two matrix products
per batch: presence x landmarks, then kernel x weights.

Fitting uses a bounded sample (``per_lang`` texts expected for each language, drawn by a hash of doc_id over all
labelled rows) on the driver; scoring runs over all rows in Arrow batches. Null texts and texts without a letter are
``und`` with score 0; so is everything when no labelled row exists. Ties go to the label that sorts first. Rows whose
doc_id is null are scored, never learned from, and are not held out. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import prepare

UND = "und"
ORDERS = (1, 2, 3)
_GAP = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a text in lower case, runs of other characters as one blank."""
    plain = f" {_GAP.sub(' ', text.lower()).strip()} "
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.int64)
    codes, parts = points, [points]
    for n in ORDERS[1:]:
        if len(points) < n:
            break
        codes = (codes[:-1] << 21) | points[n - 1:]
        parts.append(codes)
    return np.unique(np.concatenate(parts))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    labels: list[str]
    vocabulary: np.ndarray  # codes of the n-grams of the landmarks
    presence: np.ndarray  # vocabulary x landmarks, divided by the root of the landmark's own number
    weights: np.ndarray  # landmarks x labels
    bias: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, own in enumerate(sets):
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            x[i, at[self.vocabulary[at] == own]] = len(own) ** -0.5
        return x @ self.presence

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, score = [UND] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.labels else []
        if rows:
            each = self.kernel([grams(texts[i]) for i in rows]) @ self.weights + self.bias
            best = each.argmax(axis=1)
            score[rows] = np.clip(each[np.arange(len(rows)), best], 0, 1)
            for i, k in zip(rows, best, strict=True):
                found[i] = self.labels[k]
        return found, score


def fit(texts: list[str], langs: list[str], landmarks: int = 48, ridge: float = 1e-3) -> Model:
    """Nystrom landmarks: the first texts of each language in the given order; ridge is relative to the row count."""
    texts_langs = [(t, g) for t, g in zip(texts, langs, strict=True) if has_letter(t)]
    labels = sorted({g for _, g in texts_langs})
    empty = np.zeros(0)
    if not labels:
        return Model([], empty, empty, empty, empty)
    sets, of = [grams(t) for t, _ in texts_langs], np.array([labels.index(g) for _, g in texts_langs])
    chosen = [i for k in range(len(labels)) for i in np.flatnonzero(of == k)[:landmarks]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    presence = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        presence[np.searchsorted(vocabulary, sets[i]), j] = len(sets[i]) ** -0.5
    model = Model(labels, vocabulary, presence, empty, empty)
    k_all = model.kernel(sets).astype(np.float64)
    values, vectors = np.linalg.eigh(k_all[chosen])
    root = vectors * np.where(values > 1e-6 * values.max(), np.maximum(values, 1e-12) ** -0.5, 0)
    phi = k_all @ root
    mean, target = phi.mean(axis=0), np.eye(len(labels))[of]
    centred = phi - mean
    beta = np.linalg.solve(centred.T @ centred + ridge * len(sets) * np.eye(phi.shape[1]), centred.T @ (target - target.mean(axis=0)))
    model.weights = (root @ beta).astype(np.float32)
    model.bias = target.mean(axis=0) - mean @ beta
    return model


def split_bucket() -> F.Column:
    """crc32 of doc_id as text, modulo 5: 0 marks the held-out rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def train(docs: DataFrame, per_lang: int = 250, landmarks: int = 48) -> Model:
    """Fit on about ``per_lang`` labelled, not held-out rows of each language; the sample is drawn from all of them."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(split_bucket() != 0)
    share = {r["lang"]: per_lang / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return fit([], [])
    cut = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.element_at(cut, F.col("lang"))).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample], landmarks)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` (default doc_id) of every row with the label and its score, under ``names``."""
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def score(batches):
        for batch in batches:
            found, value = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.string()), pa.array(value)], [*keep, *names])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(score, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def classify(docs: DataFrame, per_lang: int = 250, landmarks: int = 48) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs, train(docs, per_lang, landmarks))
    return found.select("doc_id", F.coalesce(split_bucket() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, per_lang: int = 250, landmarks: int = 48, min_score: float = 0.2) -> DataFrame:
    """The documents whose language is recognised, with the columns of the input, whatever their names."""
    label, score = (next(n for n in (f"_{base}{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("label", "score"))
    found = identify(docs, train(docs, per_lang, landmarks), docs.columns, (label, score))
    return found.where((F.col(label) != UND) & (F.col(score) >= min_score)).select(*docs.columns)
