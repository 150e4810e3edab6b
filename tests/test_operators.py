"""Set-oriented operators against plain loops on small random inputs."""

import random

from pyspark.sql import functions as F

from vitrina.operators import consistency as CN
from vitrina.operators import discovery as DI
from vitrina.operators import findings as FI
from vitrina.operators import pages as PG
from vitrina.operators import scorecard as CA
from vitrina.operators import scoring as SC

PAGE = """<!doctype html><html lang=es><head><title>Bar &quot;Pepe&quot; &amp; hijos</title>
<meta name=viewport content='width=device-width'><script type="application/ld+json">{"@type":"Bar","telephone":"954000111"}</script>
<script src=/a.js></script><!-- <a href="/oculto">no</a> --></head><body><header><ul><li><a href="/x">X</a></li></ul></header>
<h1>Hola <b>t&uacute;</b></h1><p>Uno<p>Dos<script>var a = "<a href='/no'>";</script>
<a href="tel:+34%20954">Ll&aacute;manos</a><a href="mailto:A@b.es,c@d.es?subject=x">m</a><a href="#f">f</a><a href="img/"><img alt="Foto" src="f.jpg"></a>
<form><input id=q><label for=q>Q</label><input type=hidden><select></select></form></body></html>"""


def test_page_features(spark):
    df = spark.createDataFrame([(1, 0, "https://www.bar.es/es/", PAGE)], "business_id int, seq int, url string, html string")
    p = PG.features(df).first()
    assert p["title"] == 'Bar "Pepe" & hijos' and p["lang"] == "es" and p["viewport"] == "width=device-width"
    assert p["h1"] == ["Hola tú"] and p["has_nav"]
    assert [x["href"] for x in p["links"]] == ["https://www.bar.es/x", "https://www.bar.es/es/img/"]
    assert p["links"][1]["text"] == "Foto" and p["links"][0]["internal"]
    assert p["tel_links"] == ["+34 954"] and p["mailto_links"] == ["A@b.es", "c@d.es"]
    assert p["forms"][0]["fields"] == 2 and p["forms"][0]["unlabeled"] == 1
    assert p["schema"]["types"] == ["Bar"] and p["schema"]["telephone"] == ["954000111"]
    assert "Uno Dos" in p["text"] and "var a" not in p["text"]
    assert p["scripts"] == ["https://www.bar.es/a.js"] and p["inline_scripts"] == 2 and not p["app_shell"]


def test_dedupe_keeps_first_place_and_worst_record(spark):
    rows = [(1, 5, "A", "LOW"), (1, 7, "A", "HIGH"), (1, 6, "B", "INFO"), (2, 1, "A", "MEDIUM")]
    df = spark.createDataFrame(rows, "business_id int, seq long, code string, severity string")
    got = {(r["business_id"], r["code"]): (r["seq"], r["severity"]) for r in FI.dedupe(df).collect()}
    assert got == {(1, "A"): (5, "HIGH"), (1, "B"): (6, "INFO"), (2, "A"): (1, "MEDIUM")}


def test_capped_points_equal_greedy_walk(spark):
    rnd = random.Random(7)
    points = {"CRITICAL": 15.0, "HIGH": 7.0, "MEDIUM": 3.0, "LOW": 0.5, "INFO": 0.0}
    business, findings, expected = [], [], {}
    for b in range(40):
        status = rnd.choice(["WEB_ACEPTABLE", "WEB_FUNCIONAL_CON_PROBLEMAS"])
        cap = 8 if status == "WEB_ACEPTABLE" else 35
        business.append((b, status))
        mine = [(rnd.choice(list(points)), i) for i in range(rnd.randint(0, 14))]
        findings += [(b, i, f"C{i}", s, "SEO", list(points).index(s)) for s, i in mine]
        total = 0.0
        for s, _ in sorted(mine, key=lambda m: -points[m[0]]):
            total += min(points[s], max(cap - total, 0))
        expected[b] = total
    bdf = spark.createDataFrame(business, "business_id int, website_status string")
    fdf = spark.createDataFrame(findings, "business_id int, seq long, code string, severity string, category string, sev_rank int")
    got = {r["business_id"]: r["p"] for r in SC.web_points(bdf, fdf).groupBy("business_id").agg(F.sum("points").alias("p")).collect()}
    assert {b: got.get(b, 0.0) for b in expected} == expected


def test_official_site_equals_walk(spark):
    rnd = random.Random(3)
    hosts = ["bar.es", "www.bar.es", "facebook.com", "elpais.com", "x.wixsite.com", "uno.es", "dos.es", "tres.es", "m.business.site"]
    rows, expected = [], {}
    for b in range(60):
        seen, failed, found = set(), 0, None
        for rank in range(8):
            host = rnd.choice(hosts)
            phone, cover, place, ok = rnd.random() < 0.1, rnd.choice([0.2, 0.6, 1.0]), rnd.random() < 0.3, rnd.random() < 0.8
            rows.append((b, rank, f"https://{host}/p{rank}", phone, cover, place, ok))
            domain = "wixsite.com" if host.endswith("wixsite.com") else host.removeprefix("www.").removeprefix("m.")
            if found or failed is None:
                continue
            if domain in seen:
                continue
            seen.add(domain)
            if host in ("facebook.com", "elpais.com", "m.business.site"):
                continue
            if failed >= 3:
                failed = None
                continue
            if ok and phone:
                found = (f"https://{host}/p{rank}", "phone")
            elif ok and cover >= 0.6 and place:
                found = (f"https://{host}/p{rank}", "name_location")
            else:
                failed += 1
        expected[b] = found or (None, None)
    df = spark.createDataFrame(rows, "business_id int, rnk int, url string, phone_match boolean, name_coverage double, location_hit boolean, readable boolean")
    got = {r["business_id"]: (r["url"], r["verification"]) for r in DI.official_site(df).collect()}
    assert {b: got.get(b, (None, None)) for b in expected} == expected


def test_hours_mismatch_and_contradiction(spark):
    rows = [
        (1, "a", 1, "09:00", "14:00"), (1, "b", 1, "9:00", "14:00"),  # same after normalising
        (2, "a", 1, "09:00", "20:00"), (2, "b", 1, "09:00", "20:00"), (2, "b", 1, "09:00", "18:00"),  # contradiction only
        (3, "a", 1, "09:00", "20:00"), (3, "b", 1, "10:00", "14:00"), (3, "b", 1, "17:00", "20:00"),  # split shift differs
        (4, "a", 1, "09:00", "20:00"),  # one side only
    ]
    df = spark.createDataFrame(rows, "business_id int, side string, day int, open_at string, close_at string")
    days = CN.compare_hours(df.where("side = 'a'"), df.where("side = 'b'"))
    got = {r["business_id"]: (r["contradictory_days"], r["mismatch_days"]) for r in CN.hours_verdict(days).collect()}
    assert got == {1: (0, 0), 2: (1, 0), 3: (0, 1)}


def test_contributions_sum_to_score(spark):
    import __spark_entry__  # noqa: F401
    from vitrina.plans.fixtures import tables
    from vitrina.plans.scoring_queries import business, deduped

    t = tables(spark, "/root/testdata/sf0.001")
    scores = CA.scorecard(business(t), deduped(t), t["fx_contact"])
    parts = CA.contributions(scores).groupBy("business_id").agg(F.sum("points").alias("p"))
    clash = scores.join(parts, "business_id").where(F.greatest(F.lit(0), F.least(F.lit(100), F.round("p"))) != F.col("opportunity_score"))
    assert clash.count() == 0


def test_nearest_sorts_only_the_innermost_rings(spark):
    points = [(i, 37.0 + (i * 7919 % 2001 - 1000) / 50000, -5.0 + (i * 104729 % 2003 - 1001) / 50000) for i in range(4000)]
    points += points[:50] + [(None, 37.0, -5.0), (7, 37.0001, -5.0), (8, None, -5.0)]
    places = spark.createDataFrame(points, "business_id long, lat double, lng double")
    areas = spark.createDataFrame([(1, 37.0, -5.0, 2000.0), (2, 37.01, -5.01, 900.0), (None, 36.99, -5.0, 1500.0), (3, 37.0, -5.0, 0.0), (1, 37.005, -5.0, 500.0)],
                                  "area_id long, lat double, lng double, radius_m double")
    hits = DI.within_radius(places, areas)
    best = {}
    for r in hits.collect():
        key = (r["area_id"], r["business_id"])
        best.setdefault(key, set()).add(r["distance_m"])
    got = DI.nearest(places, areas, 20).collect()
    for area in (2, None, 3):
        rows = [r for r in got if r["area_id"] == area]
        assert len(rows) == min(20, sum(a == area for a, _ in best)) == len({r["business_id"] for r in rows})
        assert all(r["distance_m"] in best[area, r["business_id"]] for r in rows)
    assert len([r for r in got if r["area_id"] == 1]) == 20
    single = spark.createDataFrame([(i, *p) for i, (_, *p) in enumerate(points[:4000])], "business_id long, lat double, lng double")
    crowd = DI.within_radius(single, areas.where("area_id = 2"))
    kept = DI.near_rings(crowd, spark.range(1).selectExpr("1L as m"), 20)
    n, all_ = kept.count(), crowd.count()
    assert 20 <= n <= 40 < all_
    close = lambda df: sorted((r["distance_m"], r["business_id"]) for r in df.collect())[:20]
    assert close(kept) == close(crowd) == [(r["distance_m"], r["business_id"]) for r in sorted(
        DI.nearest(single, areas.where("area_id = 2"), 20).collect(), key=lambda r: r["position"])]
