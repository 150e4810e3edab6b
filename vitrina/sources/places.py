"""Place listings as delivered by the two kinds of provider, brought to one row shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hours as H
from ..rules.categories import OSM_TYPE_KEYS

COMMERCIAL_SCHEMA = (
    "id string, displayName struct<text:string,languageCode:string>, formattedAddress string,"
    "addressComponents array<struct<longText:string,shortText:string,types:array<string>>>,"
    "location struct<latitude:double,longitude:double>, types array<string>, primaryType string,"
    "primaryTypeDisplayName struct<text:string>, nationalPhoneNumber string, internationalPhoneNumber string,"
    "websiteUri string, googleMapsUri string, rating double, userRatingCount int, businessStatus string,"
    "regularOpeningHours struct<periods:array<struct<open:struct<day:int,hour:int,minute:int>,"
    "close:struct<day:int,hour:int,minute:int>>>,weekdayDescriptions:array<string>>,"
    "reviews array<struct<rating:int,text:struct<text:string,languageCode:string>,"
    "originalText:struct<text:string,languageCode:string>,publishTime:string,googleMapsUri:string>>"
)
OSM_SCHEMA = (
    "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
)


def read_commercial(spark: SparkSession, path: str) -> DataFrame:
    return from_commercial(spark.read.schema(COMMERCIAL_SCHEMA).json(path))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    return from_osm(spark.read.schema(OSM_SCHEMA).json(path))


def _component(kind: str, field: str = "longText") -> Column:
    match = F.filter("addressComponents", lambda c: F.array_contains(c["types"], kind))
    return F.get(match, F.lit(0))[field]


def _joined(sep: str, *parts: Column) -> Column:
    """Non-empty parts joined, NULL when there are none."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def from_commercial(df: DataFrame) -> DataFrame:
    """Commercial provider records (``COMMERCIAL_SCHEMA``) as places."""
    text = F.coalesce
    reviews = F.filter(
        F.transform(
            F.coalesce("reviews", F.array().cast("array<struct<rating:int,text:struct<text:string,languageCode:string>,"
                       "originalText:struct<text:string,languageCode:string>,publishTime:string,googleMapsUri:string>>")),
            lambda r: F.struct(
                text(r["originalText"]["text"], r["text"]["text"], F.lit("")).alias("text"),
                r["rating"].alias("rating"), r["publishTime"].alias("publish_time"),
                text(r["originalText"]["languageCode"], r["text"]["languageCode"]).alias("language"),
                r["googleMapsUri"].alias("url"),
            ),
        ),
        lambda r: F.length(F.trim(r["text"])) > 0,
    )
    periods = F.col("regularOpeningHours.periods")
    route = _component("route")
    extra = [c for c in df.columns if c in ("business_id",)]
    return df.select(
        *extra,
        F.lit("google_places").alias("provider_key"),
        F.col("id").alias("provider_place_id"),
        F.coalesce("displayName.text", F.lit("(sin nombre)")).alias("name"),
        F.col("primaryType").alias("primary_category"),
        F.col("primaryTypeDisplayName.text").alias("primary_category_label"),
        F.coalesce("types", F.array().cast("array<string>")).alias("secondary_categories"),
        F.col("formattedAddress").alias("formatted_address"),
        F.when(route.isNotNull(), _joined(", ", route, _component("street_number"))).alias("street"),
        _component("postal_code").alias("postal_code"),
        F.coalesce(_component("locality"), _component("postal_town"),
                   _component("administrative_area_level_3")).alias("city"),
        F.coalesce(_component("administrative_area_level_2"),
                   _component("administrative_area_level_1")).alias("region"),
        _component("country").alias("country"),
        _component("country", "shortText").alias("country_code"),
        F.when(F.col("location.longitude").isNotNull(), F.col("location.latitude")).alias("lat"),
        F.when(F.col("location.latitude").isNotNull(), F.col("location.longitude")).alias("lng"),
        F.col("nationalPhoneNumber").alias("national_phone"),
        F.col("internationalPhoneNumber").alias("international_phone"),
        F.col("websiteUri").alias("provider_website"),
        F.col("googleMapsUri").alias("maps_url"),
        "rating",
        F.col("userRatingCount").alias("user_rating_count"),
        F.when(
            F.col("regularOpeningHours").isNotNull(),
            F.struct(
                H.structured_periods(F.coalesce(periods, F.array().cast(_PERIODS))).alias("periods"),
                H.structured_always_open(periods).alias("always_open"),
                F.col("regularOpeningHours.weekdayDescriptions").alias("weekday_descriptions"),
                F.lit(None).cast("string").alias("raw"),
            ),
        ).alias("opening_hours"),
        F.col("businessStatus").alias("business_status"),
        F.lit(None).cast("string").alias("provider_email"),
        F.lit(None).cast("map<string,string>").alias("provider_socials"),
        reviews.alias("reviews"),
    )


_PERIODS = (
    "array<struct<open:struct<day:int,hour:int,minute:int>,close:struct<day:int,hour:int,minute:int>>>"
)


def from_osm(df: DataFrame) -> DataFrame:
    """Map-data elements (``OSM_SCHEMA``) as places; unnamed elements are no businesses."""
    t = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    first_part = lambda c: F.trim(F.split_part(c, F.lit(";"), F.lit(1)))
    types = F.array_compact(F.array(*[
        F.when(t(k).isNotNull(), F.concat(F.lit(f"{k}="), t(k))) for k in OSM_TYPE_KEYS
    ]))
    ref = F.concat(F.col("type"), F.lit("/"), F.col("id").cast("string"))
    street = F.when(t("addr:street").isNotNull(), _joined(", ", t("addr:street"), t("addr:housenumber")))
    closed = (t("disused") == "yes") | t("disused:shop").isNotNull() | t("disused:amenity").isNotNull()
    socials = F.map_filter(
        F.create_map(
            F.lit("instagram"), t("contact:instagram"), F.lit("facebook"), t("contact:facebook"),
            F.lit("tiktok"), t("contact:tiktok"),
        ),
        lambda _, v: v.isNotNull(),
    )
    raw_hours = t("opening_hours")
    parsed = H.text_periods(raw_hours)
    extra = [F.col("center.lat"), F.col("center.lon")] if "center" in df.columns else [F.lit(None), F.lit(None)]
    lat, lon = F.coalesce("lat", extra[0]), F.coalesce("lon", extra[1])
    main = F.get(types, F.lit(0))
    return df.where(t("name").isNotNull()).select(
        F.lit("osm").alias("provider_key"),
        ref.alias("provider_place_id"),
        t("name").alias("name"),
        main.alias("primary_category"),
        F.replace(F.split_part(main, F.lit("="), F.lit(2)), F.lit("_"), F.lit(" ")).alias("primary_category_label"),
        types.alias("secondary_categories"),
        _joined(", ", street, t("addr:postcode"), t("addr:city")).alias("formatted_address"),
        street.alias("street"),
        t("addr:postcode").alias("postal_code"),
        t("addr:city").alias("city"),
        F.coalesce(t("addr:province"), t("addr:state")).alias("region"),
        t("addr:country").alias("country_code"),
        F.when(lon.isNotNull(), lat).alias("lat"),
        F.when(lat.isNotNull(), lon).alias("lng"),
        first_part(F.coalesce(t("phone"), t("contact:phone"), t("contact:mobile"))).alias("national_phone"),
        first_part(F.coalesce(t("website"), t("contact:website"), t("url"))).alias("provider_website"),
        F.concat(F.lit("https://www.openstreetmap.org/"), ref).alias("maps_url"),
        F.when(
            parsed.isNotNull(),
            F.struct(
                parsed["periods"].alias("periods"), parsed["always_open"].alias("always_open"),
                F.lit(None).cast("array<string>").alias("weekday_descriptions"), F.trim(raw_hours).alias("raw"),
            ),
        ).alias("opening_hours"),
        F.when(closed, "CLOSED_PERMANENTLY").alias("business_status"),
        first_part(F.coalesce(t("email"), t("contact:email"))).alias("provider_email"),
        F.when(F.size(socials) > 0, socials).alias("provider_socials"),
        "tags",
    )


def clean_reviews(reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews with text, blank ones dropped; texts are cut only where ``limit`` asks for it."""
    kept = reviews.where(F.length(F.trim("text")) > 0)
    return kept if limit is None else kept.withColumn("text", F.substring("text", 1, limit))
