"""Public contact points: union, priority, primary contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phone as PH
from ..functions import url as U
from ..rules.vocab import CONTACT_PRIORITY

KEY = "business_id"


def priority(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in CONTACT_PRIORITY]), kind).cast("int") - 1


def _point(kind, value, label=None, confidence="HIGH", source_url=None) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    return F.struct(
        as_col(kind).cast("string").alias("type"), as_col(value).cast("string").alias("value"),
        as_col(label).cast("string").alias("label"), as_col(source_url).cast("string").alias("source_url"),
        as_col(confidence).cast("string").alias("confidence"),
    )


def from_listing(business: DataFrame) -> DataFrame:
    """Contacts the listing itself publishes: phone, email, profiles, and a platform link given as website."""
    raw_phone = F.coalesce("international_phone", "national_phone")
    number = PH.e164(raw_phone, F.col("country_code"))
    pretty = F.coalesce("national_phone", PH.national(raw_phone, F.col("country_code")))
    site = U.website_parts(F.col("website_uri"))
    site_type = U.contact_type(site)
    socials = F.map_entries(F.coalesce("socials", F.create_map().cast("map<string,string>")))

    def profile(e: Column) -> Column:
        handle = F.regexp_replace(e["value"], "^@", "")
        link = (
            F.when(e["value"].rlike("(?i)^https?:"), e["value"])
            .when(e["key"] == "instagram", F.concat(F.lit("https://www.instagram.com/"), handle))
            .when(e["key"] == "facebook", F.concat(F.lit("https://www.facebook.com/"), e["value"]))
            .otherwise(e["value"])
        )
        return _point(F.coalesce(U.contact_type(U.parse(link)), F.lit("OTHER")), link)

    cells = F.array_compact(F.concat(
        F.array(
            F.when(number.isNotNull(), _point("PHONE", number, pretty)).when(
                F.col("national_phone").isNotNull(),
                _point("PHONE", F.col("national_phone"), F.col("national_phone"), "MEDIUM"),
            ),
            F.when(F.col("email") != "", _point("EMAIL", F.lower("email"))),
        ),
        F.transform(F.filter(socials, lambda e: F.coalesce(e["value"] != "", F.lit(False))), profile),
        F.array(F.when(
            site_type.isNotNull(), _point(site_type, U.render(site), "Enlazado como web en la ficha")
        )),
    ))
    rows = business.select(KEY, F.col("provider_key").alias("source"), F.posexplode(cells).alias("seq", "p"))
    return rows.select(KEY, F.col("seq").cast("bigint").alias("seq"), "source", "p.*")


def from_site(extraction: DataFrame) -> DataFrame:
    """Contacts found on the website, in the order of the extraction lists."""
    def each(name: str, build) -> Column:
        return F.transform(F.coalesce(name, F.array().cast(dict(extraction.dtypes)[name])), build)

    booking = F.filter(
        "booking_links",
        lambda b: b["url"].rlike("(?i)^https?:")
        & F.coalesce(U.contact_type(U.parse(b["url"])) == "BOOKING_PAGE", F.lit(False)),
    )
    cells = F.concat(
        each("phones", lambda p: _point("PHONE", p["e164"], p["national"],
                                        F.when(p["clickable"], "HIGH").otherwise("MEDIUM"), p["url"])),
        each("emails", lambda e: _point("EMAIL", e["value"], None,
                                        F.when(e["via_mailto"], "HIGH").otherwise("MEDIUM"), e["url"])),
        each("contact_forms", lambda f: _point(
            "CONTACT_FORM", f["url"],
            F.concat(F.lit("Formulario ("), f["fields"].cast("string"), F.lit(" campos)")), "HIGH", f["url"])),
        each("whatsapp", lambda w: _point("WHATSAPP", w["url"], None, "HIGH", w["found_on"])),
        each("contact_pages", lambda c: _point("CONTACT_PAGE", c, None, "HIGH", c)),
        each("socials", lambda s: _point(s["type"], s["url"], None, "HIGH", s["found_on"])),
        F.transform(F.coalesce(booking, F.array().cast(dict(extraction.dtypes)["booking_links"])),
                    lambda b: _point("BOOKING_PAGE", b["url"], b["label"])),
    )
    rows = extraction.select(KEY, F.lit("website").alias("source"), F.posexplode(cells).alias("seq", "p"))
    return rows.select(KEY, (F.col("seq") + 100_000).cast("bigint").alias("seq"), "source", "p.*")


def merge(contacts: DataFrame) -> DataFrame:
    """First record per (business, type, value without case); listing rows carry the lower ``seq``."""
    cols = [c for c in contacts.columns if c not in (KEY, "type", "seq")]
    folded = F.lower("value").alias("folded")
    best = contacts.groupBy(KEY, "type", folded).agg(
        F.min_by(F.struct(*cols), F.col("seq")).alias("c"), F.min("seq").alias("seq")
    )
    return best.select(KEY, "type", "seq", "c.*").withColumn("priority", priority(F.col("type")))


def primary(contacts: DataFrame) -> DataFrame:
    """First email and profile links per business, one aggregate pass."""
    first = lambda t: F.min_by(
        F.when(F.col("type") == t, F.col("value")), F.when(F.col("type") == t, F.col("seq")))
    return contacts.groupBy(KEY).agg(
        F.bool_or(F.col("type") == "PHONE").alias("has_phone"),
        first("EMAIL").alias("primary_email"), first("INSTAGRAM").alias("instagram_url"),
        first("FACEBOOK").alias("facebook_url"), first("WHATSAPP").alias("whatsapp_url"),
    )


def first_phone(contacts: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("label"), F.col("value")) if "label" in contacts.columns else F.col("value")
    return contacts.where(F.col("type") == "PHONE").groupBy(KEY).agg(F.min_by(text, F.col("seq")).alias("first_phone"))
