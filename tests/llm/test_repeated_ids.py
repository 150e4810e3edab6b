"""Rows that share a doc_id, and tables whose columns have the operators' names."""

import random

from vitrina.llm import jaccard, langid

WORDS = "the of and to in that for with house garden window river mountain table letter night open small green".split()


def by_hand(rows):
    """Components over doc_ids: two rows link when their sets are alike enough or they share a doc_id."""
    def members(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [members(t) for _, t in rows]
    part = {d: d for d, _ in rows if d is not None}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                lo, hi = sorted((root(a), root(b)))
                part[hi] = lo
    return sorted(((d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def test_texts_of_one_doc_id_unite_what_they_link(spark):
    rng = random.Random(2)
    text = [" ".join(rng.choices(WORDS, k=40)) for _ in range(9)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[1]), (4, text[2]), (5, text[3]), (5, text[2] + " more"), (5, ""), (6, text[4]), (6, text[4]),
            (7, text[5]), (7, text[6]), (8, None), (8, text[6]), (None, text[6]), (None, text[6]), (9, "")]
    found = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == by_hand(rows)
    assert {r["doc_id"]: r["component_id"] for r in found}[3] == 1


def test_accept_keeps_columns_named_like_its_own(spark):
    rng = random.Random(3)
    kinds = {"en": "the and ing that with er on th", "de": "der und ung sch ein die keit zu"}
    rows = [(i, " ".join("".join(rng.choices(kinds[g].split(), k=2)) for _ in range(30)), g, 0.5, "x", 1) for i, g in enumerate(rng.choice(sorted(kinds)) for _ in range(200))]
    docs = spark.createDataFrame([*rows, (200, "12 34", None, 0.1, "x", 2)], "doc_id long, text string, lang string, score double, lang_pred string, _label int")
    kept = langid.accept(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows)
