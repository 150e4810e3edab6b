"""Robots decisions by beginnings against a plain longest match, link targets and the frontier on hand-made pages."""

import random
import re

from vitrina.operators import links as LI
from vitrina.sources import robots as RO

RULES = "business_id long, kind string, seq long, value string"
PAGES = ("business_id long, seq int, home_host string, links array<struct<href:string,text:string,internal:boolean,"
         "parts:struct<scheme:string,host:string,port:string,path:string,query:string>>>, images array<struct<src:string,alt:string>>, "
         "scripts array<string>, stylesheets array<string>")


def by_hand(rules, path):
    """Longest matching rule of (allow, value) pairs."""
    best = None
    for allow, value in rules:
        body, end = (value[:-1], "$") if value.endswith("$") else (value, "")
        if re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + end, path, re.S):
            best = max(best or (-1, False), (len(value), allow))
    return path == "/robots.txt" or best is None or best[1]


def decide(spark, rules, paths):
    frame = spark.createDataFrame([(s, "allow" if a else "disallow", i, v) for i, (s, a, v) in enumerate(rules)], RULES)
    asked = spark.createDataFrame(paths, "business_id long, path string")
    return {(r["business_id"], r["path"]): r["allowed"] for r in LI.allowed_paths(asked, frame).collect()}


def test_named_cases(spark):
    text = "User-agent: *\nDisallow: /admin\nAllow: /admin/public\nDisallow: /*.pdf$\n\nUser-agent: MyBot\nDisallow: /privado\n\nSitemap: https://example.com/sitemap.xml"
    files = spark.createDataFrame([(1, text)], "business_id long, content string")
    paths = spark.createDataFrame([(1, p) for p in ("/privado/x", "/admin", "/admin/panel", "/admin/public/x", "/docs/carta.pdf", "/docs/carta.pdf?v=2")], "business_id long, path string")
    ask = lambda agent: {r["path"]: r["allowed"] for r in LI.allowed_paths(paths, RO.parse_robots(files, agent, "business_id")).collect()}
    own, other = ask("MyBot"), ask("OtherBot")
    assert not own["/privado/x"] and own["/admin"]
    assert not other["/admin/panel"] and other["/admin/public/x"] and not other["/docs/carta.pdf"] and other["/docs/carta.pdf?v=2"]


def test_against_plain_match(spark):
    rng = random.Random(9)
    piece = lambda: rng.choice(["/", "/a", "/ab", "/abc", "b", "c.php", "?x=1", "ñ", "(", "+", "[", "\\"])
    rules, paths = [], []
    for site in range(8):
        for _ in range(rng.randint(0, 12)):
            value = "/" + "".join(rng.choice([piece(), piece(), "*"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", "", "$"])
            rules.append((site, rng.random() < 0.5, value))
        rules.append((site, False, "*b") if site % 2 else (site, True, "/" + "a" * 50))
        paths += [(site, "/" + "".join(piece() for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    paths += [(0, "/robots.txt"), (99, "/free"), (3, "/" + "ab" * 3000)]
    found = decide(spark, rules, paths)
    assert found == {(s, p): by_hand([(a, v) for x, a, v in rules if x == s], p) for s, p in set(paths)}


def link(href, internal=True, host="bar.es", path=None, query=""):
    return (href, "t", internal, ("https", host, "", path or "/" + href.split("/", 3)[-1].split("#")[0], query))


def targets(spark, pages, fetched=(), rules=None, **more):
    frame = spark.createDataFrame(pages, PAGES)
    read = spark.createDataFrame(list(fetched), "business_id long, url string")
    known = None if rules is None else spark.createDataFrame([(s, k, i, v) for i, (s, k, v) in enumerate(rules)], RULES)
    rows = LI.link_targets(frame, read, known, **more).collect()
    return sorted((r["business_id"], r["target_kind"], r["position"], r["target_url"]) for r in rows)


def test_targets(spark):
    pages = [
        (1, 0, "www.bar.es", [link("https://bar.es/b#x"), link("https://bar.es/a"), link("https://bar.es/b"), link("https://bar.es/secret/1"),
                              link("https://otro.com/", False, "otro.com", "/"), link("https://shop.bar.es/", False, "shop.bar.es", "/"),
                              link("https://facebook.com/x", False, "www.facebook.com", "/x")],
         [("https://bar.es/1.jpg", None), ("data:x", None)], ["https://bar.es/s.js"], ["https://bar.es/s.css"]),
        (1, 1, "www.bar.es", [link("https://bar.es/c"), link("https://bar.es/a/")], [("https://bar.es/1.jpg", "x"), ("https://bar.es/2.jpg", None)], [], ["https://bar.es/s.css"]),
        (2, 0, "dos.es", [link("https://dos.es/x", host="dos.es")], None, None, None),
    ]
    found = targets(spark, pages, [(1, "https://bar.es/a/")], [(1, "disallow", "/secret")])
    assert found == [
        (1, "domain", 1, "otro.com"), (1, "image", 1, "https://bar.es/1.jpg"), (1, "image", 2, "https://bar.es/2.jpg"),
        (1, "link", 1, "https://bar.es/b"), (1, "link", 2, "https://bar.es/c"), (1, "resource", 1, "https://bar.es/s.js"), (1, "resource", 2, "https://bar.es/s.css"), (2, "link", 1, "https://dos.es/x")]


def test_quotas_count_what_is_left(spark):
    pages = [(1, 0, "bar.es", [link(f"https://bar.es/{'no' if i % 2 else 'si'}/{i:03}") for i in range(90)], [], [], [])]
    found = targets(spark, pages, [(1, "https://bar.es/si/000")], [(1, "disallow", "/no")], quotas=LI.QUOTAS)
    assert [f[3] for f in found] == [f"https://bar.es/si/{i:03}" for i in range(2, 52, 2)]
    assert len(targets(spark, pages)) == 90


def test_empty(spark):
    assert targets(spark, [], []) == []
    assert targets(spark, [], [(1, "x")], [(1, "disallow", "/")], quotas={"link": 1}) == []
