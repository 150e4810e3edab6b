"""Operators of vitrina.llm on small hand-made tables: brute force, round trips and the cases named in their docstrings."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitrina.llm import html_main, jaccard, langid, licenses, line_dedup, merkle, mixing, packing, token_count, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int, node string, n_lines string"
WORDS = "the of and to in that for with house garden window river mountain table letter night open small green".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(40)]
    texts = [*base, *base[:5], *[t.replace(" ", "\n", 3) for t in base[5:9]]]
    for t in base[9:15]:
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    shared = "this long line of one template stands in many documents since 2020 as it is"
    texts += [f"{sentence(rng, 30)}\n{shared.replace('2020', str(1990 + i))}\n{sentence(rng, 9)}" for i in range(6)]
    texts += [None, "", " \n\t ", "one", "one two three", "One two THREE", "½ ² 12", "x" * 30000, "a b " * 9000]
    out = [(i, t, "en" if t else None, f"s{i % 3}" if i % 7 else None, None, 1, "n", None) for i, t in enumerate(texts)]
    return [*out, (3, texts[3], "en", "s0", 5, 2, None, "z"), (None, texts[2], "en", "s1", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, docs, empty, rows):
    rng = random.Random(1)
    kinds = {"en": "the and ing that with er on th", "de": "der und ung sch ein die keit zu", "fr": "le que eau tion les une ou ai"}
    made = [(i, " ".join("".join(rng.choices(kinds[g].split(), k=rng.randint(1, 3))) for _ in range(40)), g)
            for i, g in enumerate(rng.choice(sorted(kinds)) for _ in range(400))]
    found = langid.classify(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    truth = {i: g for i, _, g in made}
    held = [r for r in found if r["held_out"]]
    assert len(found) == 400 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.classify(docs).collect()}
    assert all(odd[i] == ("en" if any(map(str.isalpha, t or "")) else "und") for i, t, *_ in rows)
    assert langid.classify(empty).collect() == [] and langid.accept(docs).columns == docs.columns


def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body class='has-sidebar'><header><h1>Site</h1></header><nav>menu here</nav>{}"
            "<div class=sidebar><a href=x>one</a> two</div><script>if (a<b) x='</p>'</script><footer>end</footer></body></html>")
    inner = ("<{0}><h1>Caf&eacute; &amp; bar</h1><p>Some <b>bo</b>ld words&nbsp;and   more<p>unclosed<br>line"
             "<div class='ad-box'>buy</div><ul><li>a<li>b</ul><form>sign up</form><section id=comments><p>nice!</section></{0}>")
    want = "Café & bar Some bold words and more unclosed line a b"
    pages = [(1, "u", page.format(inner.format("article"))), (2, "u", page.format(inner.format("div"))), (3, None, None), (4, "u", ""),
             (5, "u", "<p"), (6, "u", "plain words"), (6, "u", "plain words"), (7, "u", "<article>" + "<p>w</p>" * 20000 + "</article>")]
    out = html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == 8 and text[1] == want and text[2] == want and text[3] == text[4] == text[5] == "" and text[6] == "plain words"
    assert text[7] == " ".join(["w"] * 20000) and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.unescape("&eacute;") == "é" and html_main.best_run([-1, 2, -1, 3, -5, 1]) == (1, 4) and html_main.best_run([-1]) == (0, 0)


def test_main_text_beside_articles():
    body = "<p>" + "</p><p>".join(["several plain words of text"] * 30) + "</p>"
    page = "<body><div><h1>Head</h1>{}</div><ul><li><a href=a>more</a></li></ul><article><p>short teaser</p></article></body>"
    text = html_main.extract(page.format(body), {})
    assert text == "Head " + " ".join(["several plain words of text"] * 30)


def test_main_text_in_wrappers():
    body = "<p>" + "</p><p>".join(["several plain words of text"] * 30) + "</p>"
    want = " ".join(["several plain words of text"] * 30)
    for attrs in ("class='content-sidebar-wrap'", "id='page' class='layout-sidebar-right'", "class='social-science'", "class='post-with-share'"):
        for name in ("article", "main", "div"):
            page = f"<body><h5>Site</h5><div {attrs}><{name}>{body}</{name}><div class=sidebar>aside</div></div></body>"
            assert html_main.extract(page, {}) in (want, "Site " + want)
    assert html_main.extract(f"<body><article><p>short text</p><section id=comments>{body}</section></article></body>", {}) == "short text"


def test_mixing(docs, empty, rows):
    out = mixing.taken(docs, block_words=16, shard_slots=64).collect()
    size = {(i, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, s, *_ in rows}
    total = Counter()
    for i, t, _, s, *_ in rows:
        total[s] += size[i, s]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * total[s] for s in over}
        left -= sum(want[s] for s in over)
        open_ -= over
    assert len(out) == len(rows)
    by = defaultdict(int)
    for r in out:
        s = next(s for s in order if total[s] == r["source_size"])
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        by[s] += r["taken"]
    assert all(abs(by[s] - want[s]) <= 1 for s in order)
    assert sorted(map(str, out)) == sorted(map(str, mixing.taken(docs, 16, 64).collect()))
    mixed = mixing.mixed_documents(docs, 16, 64)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in out)
    assert mixing.taken(empty).collect() == []


def test_lines(docs, empty, rows):
    out = line_dedup.dedup(docs)
    text = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
    shared = [i for i, t, *_ in rows if t and "one template" in t]
    assert [text[i][1] for i in shared] == [0] + [1] * 5 and all("one template" not in text[i][0] for i in shared[1:])
    assert text[41] == ("", 1) and text[1][1] == 0  # the copy loses its line, the first document keeps it
    assert {i for i, t, *_ in rows if t is None} <= {i for i, v in text.items() if v[0] is None}
    kept = line_dedup.clean_documents(docs)
    assert kept.columns == docs.columns and 41 not in {r["doc_id"] for r in kept.collect()}
    assert line_dedup.digest(empty).collect() == []


def test_lines_keep_new_words(spark):
    rng = random.Random(11)
    a, b = (" ".join(rng.choices(WORDS, k=40)) for _ in range(2))
    w, x = a.split(), b.split()
    new = " ".join(w[:31] + [f"new{c}" for c in "abcdefghi"])  # only its last quarter is new
    mixed = " ".join(w[:3] + ["m"] * 9 + w[12:21] + x[21:])
    other = " ".join(w[:3] + ["m"] * 9 + ["n"] * 9 + x[21:])
    texts = [a, other, new, mixed, a, "net sales 4 5 6 7 8", "net sales 9 8 7 6 5", "net sales 9 8 7 6 5",
             "last changed on day 4 by the office", "last changed on day 5 by the office"]
    rows = spark.createDataFrame([(i, f"own{i}\n{t}") for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"].count("\n") for r in line_dedup.clean_documents(rows).collect()}
    assert {i for i, n in out.items() if not n} == {4, 7, 9}


def test_short_lines(spark):
    texts = ["one\nAll rights reserved.\n---\n\nMenu\nTotal 5\n© 2020 Some Name", "two\nAll  rights reserved. \n---\n\nMenu\nTotal 6\n© 2021 Some Name",
             "three\nTotal 5\nmenu"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.clean_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: texts[0], 1: "two\n---\n\nTotal 6", 2: "three\nmenu"}


def test_pipeline_lines_go_down_the_tree(spark, monkeypatch):
    line = "the quick brown fox jumps over the lazy dog and never returned"
    texts = [f"one\n{line} home\nAll rights reserved.", f"two\n{line}  home\nAll rights reserved.", f"three\n{line} here\nall rights reserved."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r["gone"] for r in line_dedup.dropped_lines(rows, whole=True).collect()}
    assert found == {1: [1, 2]}
    runs = line_dedup.nodes(rows, whole=True).groupBy("id", "line_no").count().collect()
    assert sorted(r["count"] for r in runs if r["line_no"] == 1) == [5] * 3 and all(r["count"] == 2 for r in runs if r["line_no"] != 1)
    tree = line_dedup.nodes
    monkeypatch.setattr(line_dedup, "nodes", lambda *a: tree(*a).where("needed is null"))
    assert [r["text"] for r in line_dedup.clean_documents(rows).orderBy("doc_id").collect()] == texts  # nothing goes without the tree


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, 16))
    x[200:210] = x[200]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, [1.0, 2.0]), (None, rows[0][1])]
    out = {r["vec_id"]: r for r in vector_dedup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array([v for _, v in rows[:300]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(out) == len(rows)
    assert sum(out[i]["n_links"] for i in range(300)) >= 0.97 * near.sum() and all(out[i]["n_links"] <= near[i].sum() for i in range(300))
    assert {out[i]["component_id"] for i in range(100, 160)} == {100} and out[200]["n_links"] == 9 and not out[205]["kept"]
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(300, 305))


def test_vectors_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[:160] = x[0] + 0.05 * rng.normal(size=(160, 16))  # one group that is found, and pairs that the search misses
    x[201:400:2] = x[200:400:2] + 0.01 * rng.normal(size=(100, 16))
    search = vector_dedup.links_of
    monkeypatch.setattr(vector_dedup, "links_of", lambda *a: search(*a).where("a < 200"))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = {r["vec_id"]: r for r in vector_dedup.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(out[i]["component_id"] == i - i % 2 and out[i]["n_links"] >= 1 for i in range(200, 400))
    assert vector_dedup.worst_class([(100, 100)] * 60 + [(1, 0)] * 9 + [(1, 1)] * 1) == 0.1 and vector_dedup.worst_class([(0, 0)]) == 1


def test_token_counts(docs, empty, rows):
    tokenizer = token_count.load(token_count.vocabulary())
    out = token_count.counts(docs, huge=2000, chunk=600, overlap=100).collect()
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in out) and token_count.counts(empty).collect() == []
    rng, alphabet = random.Random(5), ["a", "Z", "é", " ", "  ", "\n", "'s", "12", "!?", "<|endoftext|>", "<|end", "\x1c", " ", "漢", "x" * 40, " " * 90]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 300)))
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert token_count.resync(tokenizer, text, 400, 100) == n == token_count.Counter(token_count.vocabulary(), 10**9, 400, 100).count(text)


def test_fingerprints(docs, empty, rows):
    out = merkle.compare(docs, rows_per_bucket=10).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want[i, len(t), hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    by_text = defaultdict(set)
    for i, t, *_ in rows:
        by_text[t or ""].add(merkle.fingerprint(t))
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) == len(by_text)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out) and merkle.compare(empty).collect() == []
    rng = random.Random(2)
    paragraphs = [sentence(rng, 40) for _ in range(20)]
    a, b = "\n".join(paragraphs), "\n".join([*paragraphs[:10], "something new here", *paragraphs[11:]])
    assert 0.8 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert len(merkle.differences(merkle.fingerprint(a), merkle.fingerprint(b))) == 1


def test_packing(docs, empty, rows):
    path = packing.vocabulary("word_bpe_49k.json")
    tokenizer = packing.load(path)
    out = packing.pack(docs, window=256, group_windows=8).collect()
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    covered, places = Counter(), defaultdict(list)
    for r in out:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: sum(map(len, x)) for i, x in ids.items()}
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 256
    assert sum(covered.values()) >= 0.9 * 256 * len(places) and packing.pack(empty).collect() == []
    sets = packing.windows([5, 9, 4, 8, 3, 7, 6, 2], 11)
    assert sorted(i for s in sets for i in s) == list(range(8)) and len(sets) == 4


def test_jaccard(docs, empty, rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(5, len(w))
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    sets = defaultdict(list)
    for i, t, *_ in rows:
        sets[i].append(shingles(t))
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = jaccard.groups(docs).collect()
    want = Counter((i, len(s), None if i is None else find(i)) for i in sets for s in sets[i])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert jaccard.one_of_each(docs).columns == docs.columns and jaccard.groups(empty).collect() == []


def test_licenses(spark, empty):
    apache = licenses.TEMPLATES["Apache-2.0-header"]
    rows = [(1, "x " * 40 + apache + " y" * 40), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (3, None), (4, ""),
            (5, "a license to read"), (6, apache.replace("obtain", "get")), (None, "ALL RIGHTS\nreserved")]
    out = Counter((r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == {(1, "Apache-2.0-header"): 1, (1, "Apache-2.0"): 1, (2, "MIT"): 2, (6, "Apache-2.0-header"): 1, (6, "Apache-2.0"): 1,
                   (None, "All-rights-reserved"): 1}
    assert licenses.scan(empty).collect() == []


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.drop("extra", "node", "n_lines").write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, stage(spark, frame, str(tmp_path)).cache()
        assert frame.count() > 0 and (k == 4 or frame.columns == before.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()
