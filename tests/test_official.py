"""Official-site verification on hand-made hits and home pages."""

from vitrina.operators import official as OF

BUSINESS = "business_id long, name string, city string, postal_code string, country_code string, national_phone string, international_phone string, provider_key string"
CAPTURE = "requested_url string, attempt int, url string, status int, content_type string, error_code string, html string"


def page(title, body):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def search(spark, hits, captures, business=None, **more):
    rows = business or [(1, "Bar Pepe Triana", "Sevilla", "41010", "ES", "954 123 456", None, "google_places")]
    return {r["business_id"]: r for r in OF.find(
        spark.createDataFrame(rows, BUSINESS), spark.createDataFrame(hits, "business_id long, rnk int, url string, title string, snippet string"),
        spark.createDataFrame(captures, CAPTURE), **more).collect()}


def hit(rnk, url, business=1):
    return (business, rnk, url, None, None)


def test_phone_wins_and_ends_the_walk(spark):
    found = search(spark, [hit(0, "https://www.facebook.com/pepe"), hit(1, "https://uno.es/x"), hit(2, "https://shop.uno.es/y"), hit(3, "https://dos.es/"), hit(4, "https://tres.es/")], [
        ("https://uno.es/", 1, "https://uno.es/", 200, "text/html", None, page("Uno", "nada")),
        ("https://dos.es/", 1, "https://dos.es/es", 200, "text/html", None, page("Dos", '<a href="tel:+34954123456">x</a>')),
        ("https://tres.es/", 1, "https://tres.es/", 200, "text/html", None, page("Bar Pepe Triana", "Sevilla"))])[1]
    assert (found["url"], found["verification"]) == ("https://dos.es/es", "phone")
    assert [tuple(c) for c in found["candidates"]] == [("https://uno.es/", "Coincidencia insuficiente (nombre 0%, ubicación no)")]


def test_three_failures_stop_the_search(spark):
    hits = [hit(i, f"https://s{i}.es/") for i in range(5)]
    captures = [("https://s0.es/", 1, "https://s0.es/", 404, "text/html", None, "x"), ("https://s1.es/", 1, "https://s1.es/", None, None, "TIMEOUT", None),
                ("https://s3.es/", 1, "https://s3.es/", 200, "text/html", None, page("Bar Pepe Triana", "Sevilla"))]
    found = search(spark, hits, captures)[1]
    assert found["url"] is None and [c["reason"] for c in found["candidates"]] == ["No verificable (HTTP 404)", "No verificable (TIMEOUT)", "No verificable (error)"]
    assert search(spark, hits, captures, max_candidates=4)[1]["url"] == "https://s3.es/"


def test_name_needs_the_place(spark):
    there = search(spark, [hit(0, "https://uno.es/")], [("https://uno.es/", 1, "https://uno.es/", 200, "text/html", None, page("BAR PÉPE", "Triana, 41010"))])[1]
    assert (there["url"], there["verification"]) == ("https://uno.es/", "name_location")
    elsewhere = search(spark, [hit(0, "https://uno.es/")], [("https://uno.es/", 1, "https://uno.es/", 200, "text/html", None, page("Bar Pepe", "Triana, Cádiz"))])[1]
    assert elsewhere["url"] is None and elsewhere["candidates"][0]["reason"].endswith("ubicación no)")


def test_last_attempt_counts_and_long_pages_are_read_whole(spark):
    long = page("Uno", "<p>" + "palabra " * 20000 + "</p><p>Tel. 954 123 456</p>")
    found = search(spark, [hit(0, "https://uno.es/")], [("https://uno.es/", 1, "https://uno.es/", None, None, "TIMEOUT", None), ("https://uno.es/", 2, "https://uno.es/", 200, "text/html", None, long)])[1]
    assert found["verification"] == "phone"


def test_findings_and_notes(spark):
    business = [(1, "Bar Pepe Triana", "Sevilla", None, "ES", "954123456", None, "osm"), (2, "Otro", None, None, None, None, None, "osm"), (3, "Nadie", "", None, "ES", None, None, "google_places")]
    hits = [hit(0, "https://uno.es/"), hit(0, "https://uno.es/", 2), hit(1, "no url", 3)]
    captures = [("https://uno.es/", 1, "https://uno.es/", 200, "text/html", None, page("x", '<a href="tel:954123456">x</a>'))]
    frame = spark.createDataFrame(business, BUSINESS)
    found = OF.find(frame, spark.createDataFrame(hits, "business_id long, rnk int, url string, title string, snippet string"), spark.createDataFrame(captures, CAPTURE))
    assert found.count() == 3
    previous = spark.createDataFrame([(b, 1, "WEBSITE_IS_THIRD_PARTY", "PRESENCE", "HIGH", "ANALYZED", "HIGH", "t", "d", "e") for b in (1, 2)],
                                     "business_id long, seq long, code string, category string, severity string, provenance string, confidence string, title string, description string, evidence string")
    rows = {(r["business_id"], r["code"]): r for r in OF.found_findings(found, frame, previous).collect()}
    assert set(rows) == {(1, "WEBSITE_IS_THIRD_PARTY"), (1, "GOOGLE_LISTING_MISSING_WEBSITE")}
    assert rows[(1, "WEBSITE_IS_THIRD_PARTY")]["severity"] == "INFO" and rows[(1, "GOOGLE_LISTING_MISSING_WEBSITE")]["evidence"] == "https://uno.es/"
    assert "OpenStreetMap" in rows[(1, "GOOGLE_LISTING_MISSING_WEBSITE")]["title"]
    assert [r["business_id"] for r in OF.search_notes(found).collect()] == [2]
