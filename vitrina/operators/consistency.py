"""Listing against website: phones, address, hours, status and signs of age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours as H
from ..functions import phone as PH
from ..functions import text as T
from ..rules.patterns import STREET_TYPE_WORDS
from .findings import emit, finding
from .scoring import provider_label

KEY = "business_id"


def hours_by_day(periods: DataFrame, *keys: str) -> DataFrame:
    """Distinct normalised intervals per day as one sorted text. Input: keys, day, open_at, close_at."""
    span = F.concat(H.clock(F.col("open_at")), F.lit("-"), H.clock(F.col("close_at"), True))
    return periods.select(*keys, "day", span.alias("span")).groupBy(*keys, "day").agg(
        F.array_sort(F.collect_set("span")).alias("spans")
    )


def spans_overlap(spans: Column) -> Column:
    """True when two intervals of a day cross; a close at or before its open runs past midnight.

    A day holds a handful of distinct intervals, so the check stays inside its array.
    """
    def edges(s: Column) -> Column:
        o = H.minute_of_day(F.split_part(s, F.lit("-"), F.lit(1)))
        c = H.minute_of_day(F.split_part(s, F.lit("-"), F.lit(2)))
        return F.struct(o.alias("o"), F.when(c <= o, c + 1440).otherwise(c).alias("c"))

    def crossing(xs: Column) -> Column:
        return F.exists(
            F.transform(xs, lambda x, i: (i > 0) & (x["o"] < F.get(xs, i - 1)["c"])), lambda b: F.coalesce(b, F.lit(False))
        )

    ordered = F.array_sort(F.transform(spans, edges))
    return F.coalesce(T.let(ordered, crossing), F.lit(False))


def compare_hours(listing: DataFrame, website: DataFrame) -> DataFrame:
    """Per business and day: both sides' text, whether they differ, contradict themselves, or truly disagree.

    Only businesses with hours on both sides are compared.
    """
    a = hours_by_day(listing, KEY).withColumnRenamed("spans", "listing_spans")
    b = hours_by_day(website, KEY).withColumnRenamed("spans", "website_spans")
    both = a.select(KEY).distinct().join(b.select(KEY).distinct(), KEY, "left_semi")
    days = a.join(b, [KEY, "day"], "full_outer").join(both, KEY, "left_semi")
    text = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("cerrado"))
    differs = text("listing_spans") != text("website_spans")
    contradictory = differs & spans_overlap(F.col("website_spans"))
    excused = contradictory & F.coalesce(
        (F.size("listing_spans") > 0) & (F.size(F.array_except("listing_spans", "website_spans")) == 0), F.lit(False)
    )
    return days.select(
        KEY, "day", text("listing_spans").alias("listing"), text("website_spans").alias("website"),
        differs.alias("differs"), contradictory.alias("contradictory"), (differs & ~excused).alias("mismatch"),
    )


def hours_verdict(days: DataFrame) -> DataFrame:
    return days.groupBy(KEY).agg(
        F.count_if("contradictory").alias("contradictory_days"), F.count_if("mismatch").alias("mismatch_days")
    )


def phone_facts(df: DataFrame) -> DataFrame:
    """Add ``listing_phone`` (E.164), ``web_phones`` and ``phone_result`` to rows with listing and site phones."""
    listing = PH.e164(F.coalesce("international_phone", "national_phone"), F.col("country_code"))
    declared = F.filter(
        F.transform(F.coalesce("schema_phones", F.array().cast("array<string>")),
                    lambda p: PH.e164(p, F.col("country_code"))),
        lambda p: p.isNotNull(),
    )
    web = F.array_distinct(F.concat(F.coalesce("site_phones", F.array().cast("array<string>")), declared))
    df = df.withColumns({"listing_phone": listing, "web_phones": web})
    some = F.size("web_phones") > 0
    known = F.col("listing_phone").isNotNull()
    return df.withColumn(
        "phone_result",
        F.when(known & some, F.when(F.array_contains("web_phones", F.col("listing_phone")), "match").otherwise("mismatch"))
        .when(some, "missing_in_provider").when(known, "missing_in_website").otherwise("not_comparable"),
    )


def address_facts(df: DataFrame) -> DataFrame:
    """Add ``address_result`` and ``address_compared``: postal codes first, else a street word in the site text."""
    schema = F.coalesce("schema_postal_codes", F.array().cast("array<string>"))
    codes = F.array_distinct(F.concat(schema, F.coalesce("postal_codes", F.array().cast("array<string>"))))
    texts = F.coalesce("address_texts", F.array().cast("array<string>"))
    own = F.nullif(F.trim("postal_code"), F.lit(""))
    words = F.filter(
        F.split(T.normalize_text(F.col("street")), r"[\s,]+"),
        lambda w: (F.length(w) >= 4) & ~w.isin(STREET_TYPE_WORDS),
    )
    df = df.withColumns({"own_postal": own, "web_postals": codes, "street_words": words,
                         "site_address": T.normalize_text(F.array_join(texts, " "))})
    by_postal = F.col("own_postal").isNotNull() & (F.size("web_postals") > 0)
    by_street = ~by_postal & F.col("street").isNotNull() & (F.size(texts) > 0)
    hit = F.exists("street_words", lambda w: F.contains(F.col("site_address"), w))
    usable = F.size("street_words") > 0
    return df.withColumns({
        "address_result": F.when(by_postal, F.when(F.array_contains("web_postals", F.col("own_postal")), "match").otherwise("mismatch"))
        .when(by_street & usable, F.when(hit, "match").otherwise("not_comparable"))
        .when(by_street, F.lit(None)).otherwise("not_comparable"),
        "address_compared": F.coalesce(by_postal | (by_street & usable), F.lit(False)),
        "address_structured": F.size(schema) > 0,
    }).drop("street_words", "site_address")


PENALTY = {
    "PHONE_MISMATCH": 25, "PROVIDER_MISSING_PHONE": 5, "WEBSITE_HOURS_CONTRADICTORY": 10, "HOURS_MISMATCH": 20,
    "STATUS_CONFLICT": 20, "STALE_COVID_NOTICE": 15, "OLD_COPYRIGHT": 5, "SITEMAP_STALE": 5,
}


def consistency_rules(as_of: Column) -> list[tuple[Column, Column]]:
    """Rules over a row with phone, address, hours and age facts."""
    pname = provider_label(F.col("provider_key"))
    year = F.year(as_of)
    strong_dates = (F.col("dated_count") >= 2) | (F.col("oldest_year") <= year - 3)
    open_listing = F.coalesce(F.col("business_status") == "OPERATIONAL", F.lit(True))
    structured = F.col("address_structured")
    return [
        (F.col("phone_result") == "mismatch",
         finding("PHONE_MISMATCH", "MEDIUM", value=pname,
                 confidence=F.when(F.size("web_phones") <= 2, "MEDIUM").otherwise("LOW"),
                 evidence=F.array_join("web_phones", ", "))),
        (F.col("phone_result") == "missing_in_provider",
         finding("PROVIDER_MISSING_PHONE", "LOW", value=pname, evidence=F.get("web_phones", F.lit(0)))),
        (F.coalesce(F.col("address_result") == "mismatch", F.lit(False)),
         finding("ADDRESS_MISMATCH", F.when(structured, "MEDIUM").otherwise("LOW"),
                 confidence=F.when(structured, "MEDIUM").otherwise("LOW"), evidence=F.array_join("web_postals", ", "))),
        (F.col("contradictory_days") > 0, finding("WEBSITE_HOURS_CONTRADICTORY", "LOW")),
        (F.col("mismatch_days") > 0, finding("HOURS_MISMATCH", "MEDIUM", value=pname, confidence="MEDIUM")),
        (F.col("temp_closed_text").isNotNull() & open_listing,
         finding("STATUS_CONFLICT", "MEDIUM", provenance="INFERRED", confidence="MEDIUM", evidence=F.col("temp_closed_text"))),
        (F.col("covid_text").isNotNull(),
         finding("STALE_COVID_NOTICE", "MEDIUM", provenance="INFERRED", confidence="MEDIUM", evidence=F.col("covid_text"))),
        (F.col("dated_count") > 0,
         finding("OLD_DATED_CONTENT", F.when(strong_dates, "MEDIUM").otherwise("LOW"), provenance="INFERRED",
                 confidence=F.when(strong_dates, "MEDIUM").otherwise("LOW"))),
        (F.col("latest_copyright") <= year - 3,
         finding("OLD_COPYRIGHT", "LOW", value=F.col("latest_copyright"), provenance="INFERRED", confidence="LOW")),
        (F.unix_seconds(as_of) - F.unix_seconds("sitemap_lastmod") > 730 * 86400,
         finding("SITEMAP_STALE", "LOW", provenance="INFERRED", confidence="MEDIUM")),
    ]


def consistency_findings(facts: DataFrame, as_of: Column) -> DataFrame:
    return emit(facts, consistency_rules(as_of), [KEY], base_seq=300_000)


def penalty_of(code: Column, severity: Column) -> Column:
    fixed = F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv])[code]
    return F.coalesce(
        fixed,
        F.when(code == "ADDRESS_MISMATCH", F.when(severity == "MEDIUM", 25).otherwise(10)),
        F.when(code == "OLD_DATED_CONTENT", F.when(severity == "MEDIUM", 15).otherwise(8)),
        F.lit(0),
    )


def consistency_score(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """0-100 per business, NULL when nothing was comparable and nothing was found."""
    sums = findings.groupBy(KEY).agg(
        F.sum(penalty_of(F.col("code"), F.col("severity"))).alias("penalty"), F.count("*").alias("signals")
    )
    comparable = (
        F.col("phone_result").isin("match", "mismatch") | F.col("address_compared") | F.col("hours_compared")
    )
    return facts.join(sums, KEY, "left").select(
        KEY,
        F.when(comparable | (F.col("signals") > 0), F.greatest(F.lit(0), 100 - F.coalesce("penalty", F.lit(0))))
        .cast("bigint").alias("consistency_score"),
    )


def comparisons(facts: DataFrame) -> DataFrame:
    """Field-by-field comparison rows, one per field that has something to say."""
    cell = lambda field, a, b, result: F.struct(
        F.lit(field).alias("field"), a.cast("string").alias("provider_value"), b.cast("string").alias("website_value"),
        result.cast("string").alias("result"))
    no = F.lit(None)
    open_listing = F.coalesce(F.col("business_status") == "OPERATIONAL", F.lit(True))
    hours_result = F.when(F.col("hours_compared"), F.when(F.col("mismatch_days") > 0, "mismatch").otherwise("match")).otherwise("not_comparable")
    cells = F.array_compact(F.array(
        cell("phone", F.col("listing_phone"), F.nullif(F.array_join("web_phones", ", "), F.lit("")), F.col("phone_result")),
        F.when(F.col("address_result").isNotNull(), cell("address", F.coalesce("own_postal", "street"), F.nullif(F.array_join("web_postals", ", "), F.lit("")), F.col("address_result"))),
        cell("hours", F.when(F.col("mismatch_days") > 0, F.concat(F.col("mismatch_days").cast("string"), F.lit(" día(s) distintos"))), no, hours_result),
        F.when(F.col("temp_closed_text").isNotNull() & open_listing,
               cell("status", F.coalesce("business_status", F.lit("sin dato")), F.lit("cerrado temporalmente"), F.lit("mismatch"))),
    ))
    return facts.select(KEY, F.inline(cells))
