"""Saved analyses and the tables kept current from them: upserts, replacement, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contacts as CO
from . import dashboard as DA
from . import findings as FI

KEY = "business_id"

# Listing columns the provider owns; everything else on a business row is our own work and survives an upsert.
PROVIDER_COLUMNS = [
    "name", "category_key", "primary_category", "secondary_categories", "formatted_address", "street", "postal_code",
    "city", "region", "country", "country_code", "lat", "lng", "national_phone", "international_phone",
    "provider_website", "maps_url", "rating", "user_rating_count", "business_status", "provider_email",
    "provider_fetched_at",
]
KEPT_WHEN_ABSENT = ["opening_hours", "provider_socials"]
PURGED_COLUMNS = [
    "formatted_address", "street", "postal_code", "lat", "lng", "national_phone", "international_phone", "rating",
    "user_rating_count", "opening_hours", "business_status", "maps_url", "provider_fetched_at",
]


def business_payload(places: DataFrame, area: dict[str, Column]) -> DataFrame:
    """Place row as business columns, missing city/region/country taken from the searched area."""
    filled = {c: F.coalesce(F.col(c), fallback) for c, fallback in area.items()}
    return places.withColumns(filled)


def upsert_business(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """New and refreshed listings merged in by (provider, place id).

    Provider columns are overwritten, NULL included; opening hours and socials only when the incoming row has them;
    lead and analysis columns stay. New rows start with ``is_new`` true.
    """
    keys = ["provider_key", "provider_place_id"]
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in keys],
                          F.lit(True).alias("seen"))
    old = current.withColumn("known", F.lit(True))
    both = old.join(new, keys, "full_outer")
    seen = F.col("seen").isNotNull()
    out: list[Column] = []
    for c in dict.fromkeys(current.columns + incoming.columns):
        if c in keys or c not in incoming.columns:
            out.append(F.col(c))
        elif c not in current.columns:
            out.append(F.col(f"new_{c}").alias(c))
        elif c in PROVIDER_COLUMNS:
            out.append(F.when(seen, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in KEPT_WHEN_ABSENT:
            out.append(F.coalesce(f"new_{c}", c).alias(c))
        else:
            out.append(F.coalesce(c, f"new_{c}").alias(c))
    return both.select(*out, F.col("known").isNull().alias("is_new"))


def link_scan(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(scan, business) links with the missing ones added; existing links are left as they are."""
    keys = ["scan_id", KEY]
    fresh = found.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def replace_contacts(current: DataFrame, analysed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Contacts after an analysis: those of every analysed business give way to the fresh set."""
    kept = current.join(analysed.select(KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def snapshot(business: DataFrame, scores: DataFrame, findings: DataFrame, contacts: DataFrame,
             reasons: DataFrame, analyses: DataFrame) -> DataFrame:
    """Business list columns refreshed from the latest analysis; one row per analysed business."""
    counts = ["technical_issue_count", "content_issue_count", "consistency_issue_count"]
    cards = scores.join(FI.issue_counts(findings), KEY, "left").fillna(0, counts).join(reasons, KEY, "left")
    return card_snapshot(business, cards, contacts, analyses)


def card_snapshot(business: DataFrame, cards: DataFrame, contacts: DataFrame, analyses: DataFrame) -> DataFrame:
    """The same from one row per business that already holds scores, issue counts and reason."""
    last = DA.latest(analyses).select(
        KEY, F.col("analysis_id").alias("latest_analysis_id"), F.col("created_at").alias("last_analyzed_at"))
    source = business.select(
        KEY, "website_status",
        F.when(F.col("website_source") != "none", F.col("website_url")).alias("website_url"))
    return (
        source.join(cards, KEY).join(CO.primary(contacts), KEY, "left").join(last, KEY, "left")
        .withColumn("has_phone", F.coalesce("has_phone", F.lit(False)))
        .withColumn("has_email", F.col("primary_email").isNotNull())
    )


def purge_listing(business: DataFrame, as_of: Column, days: int = 30, provider: str = "google_places") -> DataFrame:
    """Blank one provider's cached listing columns once older than the retention time; place id and leads stay."""
    old = F.coalesce(
        (F.col("provider_key") == provider) & (F.col("provider_fetched_at") < as_of - F.expr(f"interval {days} days")),
        F.lit(False),
    )
    purged = {
        c: F.when(old, F.lit(None)).otherwise(F.col(c)) for c in PURGED_COLUMNS if c in business.columns
    }
    return business.withColumns({**purged, "purged": old})


def purge_review_signals(analyses: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    old = F.col("created_at") < as_of - F.expr(f"interval {days} days")
    return analyses.withColumn("review_signals", F.when(old, F.lit(None)).otherwise(F.col("review_signals")))


def upsert_providers(current: DataFrame, known: DataFrame) -> DataFrame:
    new = known.select("key", *[F.col(c).alias(f"new_{c}") for c in ("name", "kind", "notes")])
    return current.join(new, "key", "full_outer").select(
        "key", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("name", "kind", "notes")]
    )


def current_notes(notes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Notes that were not deleted; newest first within a business is a read-time order."""
    return notes.join(deleted.select("note_id"), "note_id", "left_anti")


def business_card(business: DataFrame, analyses: DataFrame, findings: DataFrame, contacts: DataFrame,
                  notes: DataFrame) -> DataFrame:
    """One row per business with its latest analysis and the sizes of its attached lists."""
    count = lambda df, name: df.groupBy(KEY).agg(F.count("*").alias(name))
    last = DA.latest(analyses).select(
        KEY, "analysis_id", F.col("created_at").alias("analyzed_at"), F.col("status").alias("analysis_status"))
    names = ["findings", "contacts", "notes"]
    card = business.join(last, KEY, "left")
    for df, name in zip((findings, contacts, notes), names):
        card = card.join(count(df, name), KEY, "left")
    return card.fillna(0, names)


