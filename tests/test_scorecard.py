"""Scorecards of hand-made businesses, rule tables, lists opened again."""

import pytest
from pyspark.sql import functions as F

from vitrina.operators import scorecard as CA
from vitrina.operators import weights as WE

BUSINESS = ("business_id long, website_status string, provider_key string, category_key string, business_status string, user_rating_count int, "
            "national_phone string, search_checked boolean, analysis_complete boolean, reviews_analyzed int, technical_score int, consistency_score int, "
            "points double, found string, technical_issue_count int")
FINDING = ("business_id long, sev_rank int, seq int, code string, severity string, category string, title string, description string, confidence string, "
           "provenance string")
CONTACT = "business_id long, type string, value string"
RULE = "kind string, key string, place int, points double"
RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def business(spark, *rows):
    base = (None, "google_places", None, "OPERATIONAL", None, None, True, True, 0, None, None, 1.0, "x", 9)
    return spark.createDataFrame([(i, status, *base[1:4], n, *base[5:]) for i, status, n in rows], BUSINESS)


def findings(spark, *rows):
    return spark.createDataFrame(
        [(i, RANK[sev], seq, code, sev, cat, f"t-{code}", f"d-{code}", "HIGH", "OBSERVED") for seq, (i, code, sev, cat) in enumerate(rows)], FINDING)


def cards(spark, b, f, c=(), weights=None):
    rows = CA.scorecard(b, f, spark.createDataFrame(list(c), CONTACT), weights)
    return {r["business_id"]: r for r in rows.collect()}


def test_caps_are_used_up_in_order(spark):
    many = [(1, f"H{i}", "HIGH", "SEO") for i in range(6)] + [(1, f"C{i}", "CRITICAL", "SECURITY") for i in range(1)]
    got = cards(spark, business(spark, (1, "WEB_FUNCIONAL_CON_PROBLEMAS", None), (2, "WEB_ACEPTABLE", None)),
                findings(spark, *many, (2, "L1", "LOW", "SEO"), (2, "L0", "LOW", "UX"), (2, "I0", "INFO", "SEO")))
    assert [(p["codes"], p["points"]) for p in got[1]["parts"]] == [("C0", 15.0), ("H0", 7.0), ("H1", 7.0), ("H2", 6.0)]
    assert got[1]["opportunity_score"] == 35 and got[1]["technical_issue_count"] == 7
    assert [(p["codes"], p["points"], p["reason"]) for p in got[2]["parts"]] == [("L1,L0", 1.0, "2 mejora(s) menor(es) (SEO/UX)")]
    assert got[2]["technical_issue_count"] == 2


def test_nothing_known(spark):
    got = cards(spark, business(spark, (1, None, None), (2, "SIN_WEB", 40)), findings(spark), [(2, "PHONE", "1"), (2, "PHONE", "2"), (3, "EMAIL", "x")])
    assert got[1]["opportunity_score"] == 0 and got[1]["parts"] == [] and got[1]["contact_score"] == 0
    assert got[2]["opportunity_score"] == 56 and [p["codes"] for p in got[2]["parts"]] == ["NO_WEBSITE", None, None]
    assert cards(spark, business(spark).limit(0), findings(spark)) == {}


def test_closed_for_good_comes_to_nothing(spark):
    b = business(spark, (1, "SIN_WEB", 200)).withColumn("business_status", F.lit("CLOSED_PERMANENTLY"))
    got = cards(spark, b, findings(spark))[1]
    assert got["opportunity_score"] == 0 and sum(p["points"] for p in got["parts"]) == 0 and got["opportunity_level"] == "LOW"


def test_contributions_and_reason(spark):
    rows = CA.scorecard(business(spark, (1, None, None), (2, "SIN_WEB", 40)), findings(spark), spark.createDataFrame([(2, "PHONE", "1")], CONTACT))
    assert sorted((r["business_id"], r["component"]) for r in CA.contributions(rows).collect()) == [(2, "contact"), (2, "presence"), (2, "website")]
    texts = {r["business_id"]: r["t"] for r in rows.select("business_id", CA.reason(2).alias("t")).collect()}
    assert texts[1] is None and texts[2].startswith("+40 No se ha encontrado web oficial; +10 Negocio")


def test_rules_as_data(spark):
    rules = spark.createDataFrame(
        [("severity", "LOW", 0, 4.0), ("cap", "WEB_ACEPTABLE", 0, 6.0), ("consistency", "NEW_CODE", 0, 5.0), ("presence", "500", 0, 20.0), ("level", "HIGH", 0, 10.0)], RULE)
    found = findings(spark, (1, "L1", "LOW", "SEO"), (1, "L2", "LOW", "SEO"), (1, "NEW_CODE", "MEDIUM", "CONSISTENCY"))
    b = business(spark, (1, "WEB_ACEPTABLE", 600))
    got = cards(spark, b, found, weights=WE.load(rules))[1]
    assert [(p["component"], p["points"]) for p in got["parts"]] == [("website", 6.0), ("consistency", 5.0), ("presence", 20.0)]
    assert (got["opportunity_score"], got["opportunity_level"], got["level_reason"]) == (31, "HIGH", "Score 31 ≥ 10")
    plain = cards(spark, b, found)[1]
    assert plain["opportunity_score"] == 16
    assert cards(spark, b, found, weights=WE.load(spark.createDataFrame(WE.default_rules(), RULE)))[1] == plain


@pytest.mark.parametrize("rows", [
    [("severity", "LOW", 0, 1.0), ("severity", "LOW", 0, 2.0)], [("severity", "ODD", 0, 1.0)], [("what", "LOW", 0, 1.0)], [("presence", "many", 0, 1.0)],
    [("severity", "LOW", 0, None)], [(None, "LOW", 0, 1.0)], [("severity", "LOW", 0, float("nan"))],
    [("review", f"R{i}", 0, 1.0) for i in range(WE.MOST_RULES + 1)],
])
def test_bad_rules_are_refused(spark, rows):
    with pytest.raises(ValueError):
        WE.load(spark.createDataFrame(rows, RULE))
