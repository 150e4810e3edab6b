"""The whole analysis over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import official as OF
from .audit import Audit, analyze
from .fixtures import now
from .page_queries import _feats
from .registry import query
from .source_queries import VERIFIED
from .stages import staged


def full(t) -> Audit:
    k = F.col("business_id")
    hours = F.struct(F.array(F.struct(F.lit(1).alias("day"), F.lit("09:00").alias("open"), F.lit("20:30").alias("close"))).alias("periods"))
    business = t["fx_business"].withColumns({
        "international_phone": F.lit(None).cast("string"), "website_uri": F.col("provider_website"),
        "email": F.lit(None).cast("string"), "socials": F.lit(None).cast("map<string,string>"),
        "opening_hours": F.when(k % 2 == 0, hours)})
    pages = _feats(t)
    homes = t["fx_capture"].join(pages.where("seq = 0").select("page_id"), "page_id", "left_semi")
    probes = t["fx_probe"].drop("page_id")
    search = staged(t, "audit-search", lambda: OF.find(business.where("website_uri is null"), t["fx_web_hit"], t["fx_home_capture"]))
    return analyze(business, homes, pages, probes, t["fx_review"], now(), 2024,
                   lambda name, build: staged(t, f"audit-{name}", build), search=search)


@query("full_audit_scores", ("fx_business",))
def full_audit_scores(t):
    a = full(t)
    return a.status.select("business_id", "website_status").join(a.scores, "business_id").drop("level_reason")


@query("full_audit_findings", ("fx_business",))
def full_audit_findings(t):
    return full(t).findings.select("business_id", "code", "category", "severity", "confidence", "title")


@query("full_audit_invariants", ("fx_business",), "select count(*) as businesses, 0 as repeated_codes, 0 as bad_scores from fx_business")
def full_audit_invariants(t):
    """One row per business, one row per (business, code), scores within 0..100."""
    scores = full_audit_scores(t).agg(
        F.count("*").alias("businesses"), F.count_if(~F.col("opportunity_score").between(0, 100)).alias("bad_scores"), F.lit(1).alias("k"))
    found = full(t).findings
    repeats = found.groupBy("business_id", "code").count().agg(F.count_if(F.col("count") > 1).alias("repeated_codes"), F.lit(1).alias("k"))
    return scores.join(repeats, "k").select("businesses", "repeated_codes", "bad_scores")


@query("full_audit_search", ("fx_business", "fx_web_hit", "fx_home_capture"), f"""
select business_id, 'GOOGLE_LISTING_MISSING_WEBSITE' as kind, url as value from found where url is not null and provider_website is null
union all select business_id, 'note', '{OF.NOTE}' || candidates from found where url is null and candidates <> '' and provider_website is null""", VERIFIED)
def full_audit_search(t):
    """What the search for a site adds to the audit: the finding with the site, or the note with the candidates."""
    audit = full(t)
    found = audit.findings.where("code = 'GOOGLE_LISTING_MISSING_WEBSITE'").select("business_id", F.col("code").alias("kind"), F.col("evidence").alias("value"))
    noted = audit.notes.where(F.col("note").startswith(OF.NOTE)).select("business_id", F.lit("note").alias("kind"), F.col("note").alias("value"))
    return found.unionByName(noted)
