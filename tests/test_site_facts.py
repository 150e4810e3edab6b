"""Decoding, offsets, first links and site gates on small hand-made rows."""

from pyspark.sql import functions as F

from vitrina.functions import html as HT
from vitrina.functions import text as T
from vitrina.operators import site as SI
from vitrina.plans.audit import gated_sites
from vitrina.sources import captures as CA

CAPTURE = (
    "business_id bigint, attempt int, purpose string, requested_url string, url string, status int, error_code string,"
    "error_detail string, content_type string, robots_allowed boolean, html string, headers map<string,string>"
)


def test_decoding(spark):
    rows = [(1, b"\xef\xbb\xbfhola", "text/html"), (2, b"a\xffb", "text/html; charset=utf-8"), (3, b"caf\xe9 \x80", "text/html; charset=latin1"),
            (4, "hola".encode("utf-16-le"), "text/html; charset=utf-16le"), (5, None, "text/html"), (6, b"", "text/html; charset=windows-1252"),
            (7, "пример".encode("koi8-r"), "text/html; charset=KOI8-R"), (8, b"\xef\xbb\xbfx", "text/html; charset=nothing")]
    out = CA.decode_bodies(spark.createDataFrame(rows, "id int, body binary, ct string"), F.col("ct")).select("id", "html").collect()
    assert {r.id: r.html for r in out} == {
        1: "hola", 2: "a�b", 3: "café €", 4: "hola", 5: None, 6: "", 7: "пример", 8: "x"}


def test_offsets_of_many_matches(spark):
    texts = ["", "none", "2001", " ".join(f"{'x' * (i % 7)}{2000 + i % 20}" for i in range(1000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    import re
    for r in df.select("id", "text", T.match_offsets(F.col("text"), r"20\d{2}").alias("m")).collect():
        want = [(m.start(), m.group()) for m in re.finditer(r"20\d\d", r.text or "")]
        assert [(m["at"], m["hit"]) for m in (r.m or [])] == want


def test_first_of_each_value(spark):
    df = spark.createDataFrame([([("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5), ("c", 6)],), ([],), (None,)], "xs array<struct<url:string,n:int>>")
    got = [r[0] and [x["n"] for x in r[0]] for r in df.select(HT._first_by(F.col("xs"), "url")).collect()]
    assert got == [[1, 2, 6], [], None]


def _capture(k, url, status=200, error=None, html="<html>x", headers=None):
    return (k, 1, "first", url, url if error is None else None, status if error is None else None, error, None, "text/html", True, html, headers)


def test_gates_of_listed_addresses(spark):
    business = spark.createDataFrame(
        [(1, "https://www.facebook.com/bar"), (2, "https://bar.business.site/"), (3, "https://bar.business.site/"), (4, "https://bar.es/"),
         (5, None), (6, "https://bar.es/"), (7, "ftp://x")], "business_id bigint, website_uri string")
    captures = spark.createDataFrame(
        [_capture(3, "https://bar.business.site/", error="DNS_NOT_FOUND"), _capture(4, "https://bar.es/"), _capture(5, "https://found.es/"),
         _capture(8, "https://cf.es/", status=403, headers={"cf-mitigated": "challenge"})], CAPTURE)
    rows = gated_sites(business, captures)
    assert {r.business_id: r.gate for r in rows.select("business_id", "gate").collect()} == {
        1: "third_party", 2: "discontinued", 3: "discontinued", 4: None, 5: None, 7: "url_invalid", 8: "unverifiable"}
    assert "anti-bots" in rows.where("business_id = 8").first()["reason"]
    none = spark.createDataFrame([], "business_id bigint, code string, category string, severity string, confidence string")
    status = {r.business_id: r for r in SI.site_status(rows.withColumn("js_only", F.lit(False)), none, "business_id").collect()}
    assert status[2].website_status == status[3].website_status == "WEB_CAIDA" and status[1].website_status == "SIN_WEB"
    assert not status[2].analysis_complete and not status[3].analysis_complete and status[1].analysis_complete
