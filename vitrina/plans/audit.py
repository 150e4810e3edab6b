"""The whole analysis as one plan: listing, site, reviews -> findings, contacts, score, recommendations, snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import consistency as CN
from ..operators import contacts as CO
from ..operators import extraction as EX
from ..operators import findings as FI
from ..operators import official as OF
from ..operators import recommend as RE
from ..operators import reviews as RV
from ..operators import scorecard as CA
from ..operators import site as SI
from ..rules.categories import CATEGORIES

KEY = "business_id"


@dataclass
class Audit:
    status: DataFrame
    findings: DataFrame
    comparisons: DataFrame
    contacts: DataFrame
    contributions: DataFrame
    scores: DataFrame
    recommendations: DataFrame
    notes: DataFrame


def category_needs(business: DataFrame) -> DataFrame:
    pick = lambda i: F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.key, c[i])])[F.col("category_key")]
    return business.select(KEY, pick(7).alias("needs_booking"), pick(8).alias("needs_menu"))


def comparison_facts(business: DataFrame, extraction: DataFrame, schema: DataFrame,
                     sitemap: DataFrame | None = None) -> DataFrame:
    """One row per business with a readable site: both sides' phones, addresses, hours and age signs."""
    notice = lambda k: F.get(F.transform(F.filter("stale_notices", lambda n: n["kind"] == k), lambda n: n["text"]), F.lit(0))
    ext = extraction.select(
        KEY, F.transform("phones", lambda p: p["e164"]).alias("site_phones"), "postal_codes", "address_texts",
        "latest_copyright", F.size("dated_mentions").alias("dated_count"),
        F.array_min(F.transform("dated_mentions", lambda d: d["year"])).alias("oldest_year"),
        notice("covid").alias("covid_text"), notice("temporarily_closed").alias("temp_closed_text"),
    )
    declared = schema.groupBy(KEY).agg(
        F.array_distinct(F.flatten(F.collect_set("schema.telephone"))).alias("schema_phones"),
        F.array_distinct(F.flatten(F.collect_set("schema.postal_code"))).alias("schema_postal_codes"),
    )
    listing = business.select(KEY, F.inline("opening_hours.periods")).withColumnsRenamed({"open": "open_at", "close": "close_at"})
    website = schema.select(KEY, F.inline("schema.opening_hours")).withColumnsRenamed({"open": "open_at", "close": "close_at"})
    verdict = CN.hours_verdict(CN.compare_hours(listing, website)).withColumn("hours_compared", F.lit(True))
    cols = ["provider_key", "business_status", "national_phone", "international_phone", "country_code", "postal_code", "street"]
    df = (
        business.select(KEY, *cols).join(ext, KEY).join(declared, KEY, "left").join(verdict, KEY, "left")
        .fillna(False, ["hours_compared"]).fillna(0, ["contradictory_days", "mismatch_days", "dated_count"])
    )
    if sitemap is not None:
        df = df.join(sitemap.select(KEY, F.col("lastmod").alias("sitemap_lastmod")), KEY, "left")
    else:
        df = df.withColumn("sitemap_lastmod", F.lit(None).cast("timestamp"))
    return CN.address_facts(CN.phone_facts(df))


def gated_sites(business: DataFrame, captures: DataFrame) -> DataFrame:
    """Gates of every site that its listed address or its captures decide.

    The listed address is judged first, fetched or not; a business that lists none is judged by what was fetched for it.
    Sites that only a fetch could decide and that have none are left out.
    """
    listed = business.where("website_uri is not null").select(KEY, F.col("website_uri").alias("_listed"))
    asked = SI.capture_outcome(captures, KEY).join(listed, KEY, "full").withColumn(
        "requested_url", F.coalesce("_listed", "requested_url")).drop("_listed")
    by_address = F.coalesce(F.col("gate").isin("url_invalid", "third_party", "discontinued"), F.lit(False))
    return SI.gates(asked, KEY).where(F.col("outcome").isNotNull() | by_address)


def analyze(business: DataFrame, captures: DataFrame, pages: DataFrame, probes: DataFrame, reviews: DataFrame,
            as_of: Column, current_year: int, stage: Callable[[str, Callable[[], DataFrame]], DataFrame],
            sitemap: DataFrame | None = None, search: DataFrame | None = None) -> Audit:
    """All results for every business.

    ``search`` is what ``official.find`` gave for businesses without a site of their own. Where it verified one, the findings
    of the listed address become mere information, the listing gets its missing link as a finding, and the business no longer
    counts as one without a site; the site itself is audited when it has been fetched (``official.to_fetch``).

    ``stage(name, build)`` writes an intermediate to the shared folder and returns it read back: each is used by several
    later steps, so this avoids doing the work again and keeps every plan small.

    ``pages`` are page features (a written stage table), ``captures`` the home-page attempts. Every join is on
    ``business_id``; nothing is gathered beyond the bounded lists of one site.
    """
    gated = stage("gates", lambda: gated_sites(business, captures))
    placed = pages.join(business.select(KEY, F.col("country_code").alias("site_country")), KEY, "left")
    extraction = stage("extraction", lambda: EX.site_extraction(placed, KEY, F.coalesce("site_country", F.lit("ES")), current_year))
    rows = stage("site_rows", lambda: SI.site_rows(
        gated, pages.where("seq = 0").drop("page_id"), extraction, probes, category_needs(business), KEY))
    site_listed = site_raw = stage("site_findings", lambda: SI.audit_findings(rows, KEY))
    site = SI.site_status(rows, FI.dedupe(site_listed), KEY)
    readable = rows.where("gate is null").select(KEY)
    read_sites = extraction.join(readable, KEY, "left_semi")
    facts = stage("facts", lambda: comparison_facts(business, read_sites, pages.select(KEY, "schema"), sitemap))
    consistency = CN.consistency_findings(facts, as_of)
    state = business.drop("website_status", "technical_score", "analysis_complete", "consistency_score", "reviews_analyzed").join(
        site.select(KEY, "website_status", "technical_score", "analysis_complete"), KEY, "left"
    ).join(RV.reviews_analyzed(reviews), KEY, "left").fillna(0, ["reviews_analyzed"])
    state = state.join(CN.consistency_score(facts, consistency), KEY, "left")
    if search is not None:
        told = search.select(KEY, F.col("search_checked").alias("_searched"), F.col("url").alias("found_url"))
        state = state.join(told, KEY, "left").withColumn("search_checked", F.coalesce("_searched", "search_checked")).drop("_searched")
        site_raw = stage("found_findings", lambda: FI.union_all(
            site_listed.join(search.where("url is not null").select(KEY), KEY, "left_anti"), OF.found_findings(search, business, site_listed)))
    else:
        state = state.withColumn("found_url", F.lit(None).cast("string"))
    found = F.col("found_url").isNotNull()
    no_site = F.col("website_status").isNull() & F.col("website_uri").isNull() & ~found
    unreached = (F.col("website_status").isNull() & ~no_site) | (found & F.coalesce(F.col("website_status") == "SIN_WEB", F.lit(False)))
    state = state.withColumn("no_site", no_site).withColumn(
        "website_status", F.when(no_site, "SIN_WEB").when(unreached, "WEB_NO_VERIFICABLE").otherwise(F.col("website_status")))
    unsaved = state
    state = stage("state", lambda: unsaved)
    listing = FI.emit(state, RE.listing_rules(F.col("no_site"), F.col("search_checked"), F.lit("La ficha no publica web")), [KEY], base_seq=200_000)
    heard = RV.review_findings(stage("review_signals", lambda: RV.signals(reviews)))
    findings = stage("findings", lambda: FI.dedupe(FI.union_all(site_raw, listing, consistency, heard)))
    contacts = stage("contacts", lambda: CO.merge(CO.from_listing(business).unionByName(CO.from_site(read_sites))))
    cards = stage("cards", lambda: CA.scorecard(state, findings, contacts))
    reached = contacts.groupBy(KEY).agg(F.bool_or(F.col("type") == "EMAIL").alias("c_email"), F.bool_or(F.col("type") == "PHONE").alias("c_phone"))
    notes = RE.unverified_notes(state, reached, None if search is None else OF.search_notes(search))
    return Audit(
        status=state, findings=findings, comparisons=CN.comparisons(facts), contacts=contacts, contributions=CA.contributions(cards),
        scores=cards.drop("parts", *CA.ISSUES), recommendations=RE.recommend(state, findings), notes=notes,
    )
