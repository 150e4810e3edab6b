"""How much the n-gram join writes for documents that link, and what it deals out for copies."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from vitrina.llm import jaccard

WORDS = "the of and to in that for with house garden window river mountain table letter night open small green".split()


def steps(monkeypatch):
    """Bytes and rows of each written step, by its label."""
    found = {}
    whole = jaccard.stored

    def noted(df, label):
        out = whole(df, label)
        files = [Path(f.removeprefix("file:")) for f in out.inputFiles()]
        found.setdefault(label, []).append((sum(f.stat().st_size for f in files), out))
        return out

    monkeypatch.setattr(jaccard, "stored", noted)
    return found


def near_pairs(spark, count, words, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        text = rng.choices(WORDS, k=words)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "other"]))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_comparisons_fetch_less_than_the_sets(spark, monkeypatch):
    found = steps(monkeypatch)
    rows, docs = near_pairs(spark, 60, 900, 5)
    out = {r["doc_id"]: r for r in jaccard.groups(docs).collect()}
    assert all(out[d]["component_id"] == d - d % 2 for d, _ in rows)
    sets = 8 * sum(r["n_shingles"] for r in out.values())
    fetched = [size for label in ("ngram-sets", "ngram-texts") for size, _ in found.get(label, [])]
    assert fetched and sum(fetched) < sets / 2


def test_copies_are_not_dealt_out_and_others_keep_their_pairs(spark, monkeypatch):
    rows, _ = near_pairs(spark, 20, 60, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(None, rows[0][1]), (2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    passed = []
    posted = jaccard.prefix_rows

    def noted(docs, rank, few, through):
        out = posted(docs, rank, few, through)
        if not through:
            passed.extend(r["doc_id"] for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(jaccard, "prefix_rows", noted)
    out = {(r["doc_id"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert out == {(d, None if d is None else 0 if d in (0, 1) or 1000 <= d < 2000 else d if d >= 2000 else d - d % 2) for d, _ in rows}
    assert not [d for d in passed if 1000 <= d < 2000]


def test_only_profiles_of_documents_that_met_take_part(spark, monkeypatch):
    seen = []
    possible = jaccard.possible

    def noted(pairs, profiles):
        seen.append((pairs.count(), profiles.count()))
        return possible(pairs, profiles)

    monkeypatch.setattr(jaccard, "possible", noted)
    rng = random.Random(7)
    rows, _ = near_pairs(spark, 3, 60, 7)
    rows += [(100 + i, " ".join(f"w{rng.random()}" for _ in range(30))) for i in range(300)]
    out = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.where(F.col("doc_id") != F.col("component_id")).count() == 3
    assert seen and all(profiles <= 2 * pairs + 5 for pairs, profiles in seen)


def test_a_run_longer_than_the_first_pivots_is_met_whole(spark):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(40):  # the passage is in all; only every second text and the next one link
        own = [f"o{i // 2}.{j}" for j in range(40)]
        rows.append((i, " ".join([*shared, *own, *([] if i % 2 else [f"x{rng.random()}"])])))
    out = {r["doc_id"]: r["component_id"] for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == {i: i - i % 2 for i in range(40)}
