"""JSON-LD of any depth against a recursive walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vitrina.functions import html as HT


def walk(v, depth, limit):
    if limit is not None and depth > limit or not v:
        return []
    if isinstance(v, list):
        return [n for x in v for n in walk(x, depth + 1, limit)]
    if isinstance(v, dict):
        return ([v] if "@type" in v else []) + walk(v.get("@graph"), depth + 1, limit)
    return []


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.15:
        return rng.choice([None, 3, "x", {}, [], {"@type": "Leaf", "name": str(rng.random())}])
    if kind < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    node = {"name": str(rng.random()), "sameAs": ["[not a list", "\"@graph\""]}
    if rng.random() < 0.6:
        node["@type"] = rng.choice(["A", ["B", "C"]])
    return {**node, "@graph": made(rng, depth - 1)}


def nested(depth):
    v = {"@type": "Deep", "name": "0", "telephone": "954 12 34 56"}
    for i in range(depth):
        v = {"@graph": [v]} if i % 2 else {"@type": "Shell", "name": str(i), "@graph": v}
    return v


@pytest.mark.parametrize("limit", [None, 6, 0])
def test_as_the_walk(spark, limit):
    rng = random.Random(5)
    docs = [[made(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 3))] for _ in range(120)] + [[nested(6)], [nested(40)], []]
    rows = spark.createDataFrame([(i, [json.dumps(v) for v in d]) for i, d in enumerate(docs)], "id long, docs array<string>")
    nodes = HT.ld_nodes(F.transform("docs", F.parse_json), limit)
    names = F.transform(nodes, lambda n: F.try_variant_get(n, "$.name", "string"))
    got = {r["id"]: r["names"] for r in rows.select("id", names.alias("names")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == [n.get("name") for v in d for n in walk(v, 0, limit)]


def test_facts_of_a_deep_node(spark):
    page = f'<script type="application/ld+json">{json.dumps(nested(31))}</script><script type="application/ld+json">{{broken</script>'
    facts = HT.schema_facts(HT.json_ld(F.col("html")))
    row = spark.createDataFrame([(page,), ("",), (None,)], "html string").select(facts.alias("f")).collect()
    assert row[0]["f"]["telephone"] == ["954 12 34 56"] and "Deep" in row[0]["f"]["types"]
