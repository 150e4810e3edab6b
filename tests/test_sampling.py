"""Fair samples per scan against a loop that sends one request after the other."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators import running, sampling

HIT = "scan_id long, query_idx long, tile_idx long, rank long, place_id long, inside boolean"


def walk(pages, wanted, budget):
    """pages[query] = list of pages in the order they are asked, each a list of (place, inside)."""
    found, sent, turn = [], 0, 0
    while len(found) < wanted and any(turn < len(p) for p in pages.values()):
        for q in sorted(pages):
            if turn >= len(pages[q]) or len(found) >= wanted:
                continue
            if budget is not None and sent >= budget:
                return found, sent, True
            sent += 1
            for place, inside in pages[q][turn]:
                if inside and place not in found and len(found) < wanted:
                    found.append(place)
        turn += 1
    return found, sent, False


def made(seed, scans, size):
    rng = random.Random(seed)
    rows, asked, pages = [], [], {}
    for s in range(scans):
        for q in range(rng.randint(1, 4)):
            for tile in range(rng.randint(1, 4)):
                asked.append((s, q, tile))
                hits = [(rng.randint(0, 60), rng.random() < 0.8) for _ in range(rng.choice([0, 0, 3, 7, 8, 20]))]
                rows += [(s, q, tile, i + 1, p, ok) for i, (p, ok) in enumerate(hits)]
                parts = [hits[i:i + size] for i in range(0, len(hits), size)] or [[]]
                pages.setdefault(s, {}).setdefault(q, []).extend(parts)
    return rows, asked, pages


@pytest.mark.parametrize("wanted,budget", [(1000, None), (12, None), (25, 5), (1000, 4), (3, 1)])
def test_as_the_loop(spark, wanted, budget, monkeypatch):
    monkeypatch.setattr(sampling, "STRETCH", 2)
    rows, asked, pages = made(wanted + (budget or 0), 9, 4)
    rng = random.Random(1)
    rng.shuffle(rows)
    hits = spark.createDataFrame(rows + rows[:5], HIT)
    tiles = spark.createDataFrame(asked, "scan_id long, query_idx long, tile_idx long")
    more = {"budget": budget, "asked": tiles, "inside": "inside", "page_size": 4}
    got, usage = {}, {}
    for r in sampling.fair_sample(hits, wanted, **more).orderBy("scan_id", "position").collect():
        got.setdefault(r["scan_id"], []).append(r)
    for r in sampling.request_usage(hits, wanted, **more).collect():
        usage[r["scan_id"]] = (r["found"], r["requests"], r["budget_reached"])
    for s, of_scan in pages.items():
        found, sent, ended = walk(of_scan, wanted, budget)
        assert [r["place_id"] for r in got.get(s, [])] == found
        assert [r["position"] for r in got.get(s, [])] == list(range(1, len(found) + 1))
        assert usage[s] == (len(found), sent, ended)


def test_nulls_and_nothing(spark):
    empty = spark.createDataFrame([], HIT)
    assert sampling.fair_sample(empty, 5).count() == 0 and sampling.request_usage(empty, 5).count() == 0
    rows = [(None, 0, 0, 1, 1, True), (1, None, 0, 1, 2, True), (1, 0, 0, 1, None, True), (1, 0, 0, 2, 7, None), (1, 0, 0, 3, 8, True)]
    hits = spark.createDataFrame(rows, HIT)
    assert [r["place_id"] for r in sampling.fair_sample(hits, 5).orderBy("position").collect()] == [7, 8]
    assert [r["place_id"] for r in sampling.fair_sample(hits, 5, inside="inside").collect()] == [8]


def test_running_before_in_stretches(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.col("id") % 7).alias("v"))
    got = running.running_before(rows, ["k"], ["i"], "v", F.floor(F.col("i") / 50), "before").collect()
    assert len(got) == 500 and all(r["before"] == sum(j % 7 for j in range(r["i"]) if j % 3 == r["k"]) for r in got)
