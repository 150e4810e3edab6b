"""Conversation trie, toxicity lexicon and ranked search on small hand-made tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vitrina.llm import prefix_trie, ranked_search, toxicity

CONV = "conv_id long, turn long, role string, text string, path string, size int, shard int, h int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, held string, n long"


def conversations():
    rng = random.Random(3)
    out = []
    starts = [("system", "Be kind."), ("user", "hello"), ("user", None), (None, "")]
    for c in [*range(0, 40), *range(95, 130), 250, 251, 399, 400]:
        out += [(c, t, *(starts[rng.randrange(2)] if t < 2 else (rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"]))))
                for t in range(rng.randint(1, 9))]
    out += [(c, t, "user", x) for c in range(5000, 5040) for t, x in enumerate(["same", "copy", "of", "all"])]  # equal conversations
    out += [(600, 1, *starts[2]), (600, None, *starts[3]), (600, 1, "user", "tie"), (600, 1, "user", "tie"), (7, 3, "user", "again")]
    out += [(700, t, "user", "long " * 50) for t in range(300)] + [(None, 1, "user", "nobody"), (-3, 1, "user", "minus")]
    return [(*r, "p", 1, 2, 3) for r in out]


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in whole.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, ids in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members) for n in under)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in under)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), leaves, saved, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_shard", [None, 7, 1])
def test_trie(spark, per_shard):
    rows = [r for r in conversations() if r[0] != 700] + [r for r in conversations() if r[0] == 700][:40]
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    found = prefix_trie.nodes(frame, per_shard).collect()
    assert sorted((tuple(r) for r in found), key=str) == trie_by_hand(rows)


def test_trie_long_conversation_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(700, t, "user", "x" * t) for t in range(3000)] + [(c, 0, "user", "same") for c in range(100, 160)]
    found = {(r["conv_id"], r["depth"]): r for r in prefix_trie.nodes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 5).collect()}
    assert found[(700, 3000)]["n_leaves"] == 1 and sum(k[0] == 700 for k in found) == 3000
    ends = list(range(100, 160))  # one turn each, taken from the base or their own
    assert found[(100, 1)]["n_convs"] == len(ends)
    assert found[(100, 1)]["ends_sha256"] == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def test_trie_empty(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.nodes(empty).collect() == []
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).collect() == []


def test_skeleton_size_bound(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SKELETON", 40)
    rows = conversations()
    found = prefix_trie.nodes(spark.createDataFrame([r for r in rows if r[0] != 700], CONV), 3).collect()
    assert sorted((tuple(r) for r in found), key=str) == trie_by_hand([r for r in rows if r[0] != 700])


WORDS = "the of and house garden window Äpfel river mountain 2020 table letter night open small green 中文 x".split()


def search_docs():
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)]  # copies: ties
    rows += [(340, None), (341, ""), (342, " .,;\n"), (5, "house river"), (None, "house river"), (343, "zebra " * 3000), (344, "a-b_c É é HOUSE")]
    return [(*r, "en", "s", 1, 0.5, "h", 9) for r in rows]


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked_by_hand(docs, items, k=10):
    texts = [(i, Counter(words(t))) for i, t, *_ in docs if words(t)]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "house river house"), (2, "the of and"), (3, None), (4, ""), (5, "missing words only"), (6, "2020 Äpfel 中文 zebra É é É"), (7, "THE Mountain, night!"),
         (None, "green"), (1, "house river house")]


@pytest.mark.parametrize("width,block", [(2048, 1 << 20), (2, 1 << 20), (64, 10)])
def test_search(spark, width, block):
    docs = search_docs()
    items = spark.createDataFrame([(*i, "extra") for i in ITEMS], "item_id long, text string, rank string")
    found = ranked_search.search(spark.createDataFrame(docs, DOCS).repartition(4), items, width=width, block_bytes=block).collect()
    wanted = ranked_by_hand(docs, dict.fromkeys(i for i in ITEMS if i[1]))
    assert sorted((tuple(r) for r in found), key=str) == wanted


def test_search_empty(spark):
    docs, items = spark.createDataFrame(search_docs(), DOCS), spark.createDataFrame([i for i in ITEMS], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []
    assert ranked_search.search(docs.where("doc_id in (340, 341, 342)"), items).collect() == []


def test_bounds_are_never_below_scores():
    docs = [(i, t) for i, t, *_ in search_docs() if words(t)]
    block = ranked_search.block_of([(1, "house river house"), (2, " ".join(WORDS))])
    for width in (1, 3, 50):
        n, total = len(docs), sum(len(words(t)) for _, t in docs)
        df = ranked_search.np.array([sum(t in words(x) for _, x in docs) for t in (b.decode() for b in block.number)])
        search = ranked_search.Search(block, ranked_search.weights(n, df), n, total, 10, width)
        for _, text in docs:
            own = sorted((block.number[t], c) for t, c in ranked_search.counted(text).items() if t in block.number)
            held = ranked_search.np.array([o[0] for o in own], int)
            tf, m = ranked_search.np.array([o[1] for o in own], int), 25 + 75 * len(words(text)) * n // total
            impact = ranked_search.impacts(search.weight[held], tf, ranked_search.np.full(len(held), m))
            bound = search.sketches(ranked_search.np.zeros(len(held), int), held, impact, 1) @ search.lookup
            for i, (terms, times) in enumerate(block.asked):
                exact = sum(int(x) * dict(zip(terms.tolist(), times.tolist(), strict=True)).get(int(h), 0) for h, x in zip(held, impact, strict=True))
                assert bound[0, i] >= exact


def test_fold():
    assert toxicity.fold("You 1d10t, іdіоt! ＩＤＩＯＴ $tupid$$$ 2024 l0s3r sooooo the&&& i​diot naïve") == (
        " you idiot idiot idiot stupid ioser so the idiot naive ")
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("  12 33 ") == " "


def test_lexicon_prefers_meaning_entries():
    counts = [(" idio", 100, 0), (" idiot", 100, 0), (" idiots", 30, 0), (" idiot ", 70, 0), (" lowe", 90, 0), (" lowex", 20, 0), (" lowey", 30, 0), (" the ", 100, 900), (" rare", 2, 0)]
    kept = toxicity.chosen(counts, 200, 2000)
    assert set(kept) == {" idiot", " lowe"}


def test_exceptions_and_heaviest_entry():
    lexicon = toxicity.Lexicon({" trash": 3.0, " trashcan": 5.0}, frozenset({("trash", "day")}))
    hits = lexicon.hits(toxicity.fold("trash day, TR4SH! trashcan trash"))
    assert sorted(w for _, w in hits) == [3.0, 3.0, 5.0]


def made_up():
    rng = random.Random(11)
    plain, bad = "the of and house garden window river mountain table letter night open small green".split(), ["grubling", "snorkface", "wobblepot"]
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(plain, k=rng.randint(5, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                word = rng.choice(bad)
                text.insert(rng.randrange(len(text)), rng.choice([word, word.upper(), word.replace("o", "0"), word.replace("e", "е"), word + "s"]))
        elif i % 6 == 1:
            text.insert(rng.randrange(1, len(text)), "wobblepot stew")  # not meant
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (902, "house " * 5000), (None, "you grubling"), (903, "!?!"), (1, docs[1][1])]
    labels += [(904, 0, 1), (None, 0, 1), (5, 0, None), (1, 0, 0), (903, 0, None)]
    return [(*d, "en", "s", 1, 0.1, "x", 2) for d in docs], labels


def test_toxicity(spark):
    docs, labels = made_up()
    frame, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.scores(frame, marks).collect()
    assert len(found) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [(r["predicted"], r["doc_id"] % 6) for r in found if r["held_out"] and r["doc_id"] < 900]
    assert sum(p for p, k in held if k == 0) >= 0.9 * sum(k == 0 for _, k in held)
    assert sum(p for p, k in held if k > 1) <= 0.02 * len(held)
    by = {r["doc_id"]: r["predicted"] for r in found}
    assert by[900] == by[901] == by[902] == by[903] == 0 and by[None] == 1


def test_toxicity_without_labels(spark):
    docs, labels = made_up()
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scores(frame, marks.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.scores(frame, marks.where("toxic = 1")).collect()} == {0.0}
    assert toxicity.scores(frame.limit(0), marks).collect() == []
