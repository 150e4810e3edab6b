"""Column builders on small examples with known answers."""

import pytest
from pyspark.sql import functions as F

from vitrina.functions import display as D
from vitrina.functions import hours as H
from vitrina.functions import phone as PH
from vitrina.functions import text as T
from vitrina.functions import url as U
from vitrina.operators import export as EX
from vitrina.operators import listing as LI
from vitrina.plans.fixtures import tables
from vitrina.rules import patterns as P
from vitrina.rules import regex as RX
from vitrina.sources import robots as RO


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("9:00", "09:00"), ("23:59", "24:00"), ("00:00", "24:00"), (" 20:30:00", "20:30"), ("tarde", "tarde")])
def test_closing_clock(spark, raw, expected):
    assert one(spark, raw, lambda c: H.clock(c, True)) == expected


def test_hours_text(spark):
    got = one(spark, "Mo-Fr 09:00-14:00,17:00-20:00; Sa 10:00-14:00; PH off", H.text_periods)
    assert len(got["periods"]) == 11 and not got["always_open"]
    assert one(spark, "24/7", H.text_periods)["always_open"]
    assert one(spark, "sunrise-sunset", H.text_periods)["periods"] == []
    wrapped = one(spark, "Sa-Mo 10:00-12:00", H.text_periods)["periods"]
    assert sorted(p["day"] for p in wrapped) == [0, 1, 6]
    assert one(spark, "Mo 09:00-10:00; mal", H.text_periods)["periods"] == []


@pytest.mark.parametrize("host,path,kind", [
    ("www.facebook.com", "/x", "SOCIAL"), ("m.facebook.com", "/", "SOCIAL"), ("notfacebook.com", "/", None),
    ("www.google.com", "/maps/place/x", "MAPS"), ("www.google.com", "/search", None),
    ("sites.google.com", "/view/x", "FREE_SUBDOMAIN_BUILDER"), ("bar.business.site", "/", "DISCONTINUED_BUILDER"),
    ("wa.me", "/34", "MESSAGING"), ("bar.wixsite.com", "/", "FREE_SUBDOMAIN_BUILDER"), ("casapepe.es", "/", None)])
def test_platform(spark, host, path, kind):
    got = spark.createDataFrame([(host, path)], "h string, p string").select(U.platform(F.col("h"), F.col("p")).alias("r")).first()["r"]
    assert (got["kind"] if got else None) == kind


@pytest.mark.parametrize("raw,expected", [
    ("bar.es", "http://bar.es/"), (" HTTPS://Bar.ES/A#x ", "https://bar.es/A"), ("ftp://bar.es", None), ("", None),
    ("http://bad host/", None), ("bar.es:8080/x?y=1", "http://bar.es:8080/x?y=1"), ("http://a.es/b/../c/./d", "http://a.es/c/d")])
def test_normalize_website(spark, raw, expected):
    assert one(spark, raw, U.normalize_website) == expected


@pytest.mark.parametrize("href,expected", [
    ("/contacto", "https://bar.es/contacto"), ("carta.pdf", "https://bar.es/es/carta.pdf"), ("../x", "https://bar.es/x"),
    ("//cdn.es/a", "https://cdn.es/a"), ("?p=2", "https://bar.es/es/inicio?p=2"), ("#top", None), ("javascript:x()", None)])
def test_resolve(spark, href, expected):
    assert one(spark, href, lambda c: U.resolve(c, U.parse(F.lit("https://bar.es/es/inicio")))) == expected


@pytest.mark.parametrize("host,expected", [
    ("www.tienda.com.es", "tienda.com.es"), ("a.b.tienda.es", "tienda.es"), ("shop.bar.co.uk", "bar.co.uk"), ("bar.es.", "bar.es")])
def test_registrable_domain(spark, host, expected):
    assert one(spark, host, U.registrable_domain) == expected


def test_emails(spark):
    text = "administración@bar.es x info@BAR.es, a@example.com img@2x.png user@bar.es info@bar.es."
    assert one(spark, text, T.emails) == ["administración@bar.es", "info@bar.es"]


def test_hidden_email(spark):
    key, plain = 0x4A, "info@bar.es"
    coded = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in plain)
    assert one(spark, coded, T.hidden_email) == plain
    assert one(spark, "zz", T.hidden_email) is None


def test_dated_mentions_and_copyright(spark):
    text = "Menú de Navidad 2019. Desde 2001 feria. © 2015-2018 Bar. Oferta 2023."
    assert [m["year"] for m in one(spark, text, lambda c: T.dated_mentions(c, 2024))] == [2019]
    assert one(spark, text, T.copyright_years) == [2018]


@pytest.mark.parametrize("text,kind", [
    ("Este dominio está en venta", "PARKED"), ("Web en construcción", "UNDER_CONSTRUCTION"),
    ("Lorem ipsum dolor", "PLACEHOLDER"), ("Bar Pepe, tapas", None), ("dominio en venta " + "x y " * 250, None)])
def test_placeholder(spark, text, kind):
    assert one(spark, text, T.placeholder_kind) == kind


def test_match_offsets(spark):
    got = one(spark, "a1bb22c333", lambda c: T.match_offsets(c, r"\d+"))
    assert [(m["at"], m["hit"]) for m in got] == [(1, "1"), (4, "22"), (7, "333")]


def test_redact(spark):
    text = "GET /x?key=abc&u=1 postgres://u:pw@db Bearer abc.def="
    assert one(spark, text, T.redact) == "GET /x?key=[REDACTED]&u=1 postgres://u:[REDACTED]@db Bearer [REDACTED]"


@pytest.mark.parametrize("raw,country,expected", [
    ("954 12 34 56", "ES", "+34954123456"), ("+34 954123456", None, "+34954123456"), ("0034954123456", "es", "+34954123456"),
    ("020 7946 0958", "GB", "+442079460958"), ("12345", "ES", None), ("abc", "ES", None), ("tel:+1 (212) 555-0100", "ES", "+12125550100")])
def test_phone(spark, raw, country, expected):
    df = spark.createDataFrame([(raw, country)], "r string, c string")
    assert df.select(PH.e164(F.col("r"), F.col("c")).alias("x")).first()["x"] == expected


def test_money_rounds_like_the_stored_value(spark):
    values = [(0.125, "0,13 $"), (0.015, "0,01 $"), (0.004, "<0,01 $"), (None, "—"), (1234.5, "1234,50 $")]
    for v, expected in values:
        assert one(spark, v, D.money, "double") == expected


@pytest.mark.parametrize("raw,expected", [
    ("=1+1", "'=1+1"), ("a;b", '"a;b"'), ('di"jo', '"di""jo"'), ("a\r\nb", "a b"), ("-5", "'-5"), (None, "")])
def test_csv_cell(spark, raw, expected):
    assert one(spark, raw, EX.csv_cell) == expected


ROBOTS = """User-agent: *
Disallow: /private
Allow: /private/ok
Disallow: /*.php$

User-agent: SiteCheck
User-agent: other
Disallow: /only
Sitemap: https://x.es/sm.xml
"""


@pytest.mark.parametrize("agent,path,expected", [
    ("nobody", "/private/x", False), ("nobody", "/private/ok", True), ("nobody", "/a.php", False), ("nobody", "/a.php?x", True),
    ("sitecheck", "/private", True), ("sitecheck", "/only/x", False), ("sitecheck", "/robots.txt", True)])
def test_robots(spark, agent, path, expected):
    files = spark.createDataFrame([(1, ROBOTS)], "site_id int, content string")
    rules = RO.parse_robots(files, agent)
    paths = spark.createDataFrame([(1, path)], "site_id int, path string")
    assert RO.allowed(paths, rules).first()["allowed"] is expected


def test_filters_are_lenient():
    f = LI.parse_filters({"q": " bar ", "level": "HIGH", "websiteStatus": "nope", "minRating": "x", "hasPhone": "1", "page": "0", "pageSize": "20"})
    assert f == LI.Filters(q="bar", level="HIGH", has_phone=True, page_size=20)
    assert LI.parse_filters({"q": "x" * 101, "level": "HIGH"}) == LI.Filters()
    assert LI.parse_filters({"hasEmail": "maybe", "level": "LOW"}) == LI.Filters()
    assert LI.parse_filters({"city": "", "dir": "asc"}) == LI.Filters(dir="asc")


def test_hidden_email_computes_its_text_once(spark):
    known = {"4a23242c250a282b3864393d": "info@bar.sw", "4A23242C250A282B3864393D": "info@bar.sw", "4a2": None, "zz23242c25": None,
             "4a2324": None, "4a23242c250a282b3864393": "info@bar.sI"}
    rows = spark.createDataFrame([(h,) for h in [*known, None]], "h string")
    assert {r["h"]: r["e"] for r in rows.select("h", T.hidden_email(F.col("h")).alias("e")).collect()} == {**known, None: None}
    assert str(T.hidden_email(F.reverse("h"))).count("reverse(") == 1


def test_guarded_patterns_find_the_same(spark):
    texts = ["Lunes a viernes 10:00 - 20:00, SÁBADOS 9h a 14h, ſat 9:00-14:00", "C/ Feria 3, 41003 Sevilla; Avda. Sol 5 y ſtreet road  uno dos",
             "Este dominio está en venta. ¡Hola mundo! Lorem ipsum, IT works! ıt works! İndex of /", "Próximamente, website coming soon; PANDEMIA, covid-19; cerrado temporalmente",
             "© 2015-2018, &copy; 2012, (c) 1999, Copyright 2020; Just a moment, CAPTCHA, access denied", "", "  \t x y \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in P.FIRST:
        plain = F.regexp_extract_all("t", F.lit("(?iu)" + RX._expand(pattern, RX.EDGE)), F.lit(0))
        both = rows.select(F.regexp_extract_all("t", F.lit(RX.java(pattern)), F.lit(0)).alias("a"), plain.alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both) and any(r["b"] for r in both), pattern
        assert RX.java(pattern).startswith("(?![\\x00")
    assert one(spark, texts[-1], T.squeeze) == "x y" and one(spark, "﻿a  ", T.squeeze) == "a"
    assert one(spark, "nada", lambda c: T.match_offsets(c, P.POSTAL_CODE), "string") == [] and one(spark, None, lambda c: T.match_offsets(c, P.POSTAL_CODE)) is None


def test_customers_are_read_by_all_cores(spark):
    customers = tables(spark, "/root/testdata/sf0.001")["customer"]
    assert customers.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
