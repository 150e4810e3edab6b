"""Parts of the opportunity score by themselves: capped points, contactability, confidence, remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import lookup as _lookup
from ..rules import scoring as S
from ..rules.vocab import (
    CONTENT_CATEGORIES, PROVIDER_LABEL, SOCIAL_TYPES, TECHNICAL_CATEGORIES, WEBSITE_FIELD_RELIABILITY,
)

KEY = "business_id"


def capped(points: Column, cap: Column, order: list[Column]) -> Column:
    """Points each row still adds once the rows before it have used up part of the cap.

    The window spans one business's deduped findings, at most one row per rule code.
    """
    w = Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(points).over(w), F.lit(0.0))
    return F.least(points, F.greatest(cap - before, F.lit(0.0)))


def web_points(business: DataFrame, findings: DataFrame) -> DataFrame:
    """Points of each website finding of a working site, worst first, under the status cap."""
    cap = F.when(F.col("website_status") == "WEB_ACEPTABLE", float(S.WEB_ACCEPTABLE_CAP)).when(
        F.col("website_status") == "WEB_FUNCIONAL_CON_PROBLEMAS", float(S.WEB_PROBLEMS_CAP)
    )
    counted = F.col("category").isin(TECHNICAL_CATEGORIES + CONTENT_CATEGORIES) | (F.col("code") == "FREE_SUBDOMAIN")
    sites = business.select(KEY, cap.alias("cap")).where(F.col("cap").isNotNull())
    rows = (
        findings.where(counted)
        .withColumn("raw", _lookup(S.WEB_POINTS, F.col("severity")))
        .where(F.col("raw") > 0)
        .join(sites, KEY)
    )
    order = [F.col("raw").desc(), F.col("sev_rank"), F.col("seq")]
    return rows.withColumn("points", capped(F.col("raw"), F.col("cap"), order)).where("points > 0")


def consistency_points(findings: DataFrame) -> DataFrame:
    order = {code: i for i, code in enumerate(S.CONSISTENCY_POINTS)}
    rows = findings.where(F.col("code").isin(list(order))).withColumn(
        "place", _lookup(order, F.col("code"))
    ).withColumn("raw", _lookup({k: float(v) for k, v in S.CONSISTENCY_POINTS.items()}, F.col("code")))
    cap = F.lit(float(S.CONSISTENCY_MAX))
    return rows.withColumn("points", capped(F.col("raw"), cap, [F.col("place")])).where("points > 0")


def review_points(findings: DataFrame) -> DataFrame:
    raw = F.when(F.col("code").isin(S.STRONG_REVIEW_CODES), float(S.REVIEW_STRONG_POINTS)).otherwise(
        float(S.REVIEW_WEAK_POINTS)
    )
    rows = findings.where(F.col("category") == "REVIEWS").withColumn("raw", raw)
    cap = F.lit(float(S.REVIEWS_MAX))
    return rows.withColumn("points", capped(F.col("raw"), cap, [F.col("sev_rank"), F.col("seq")])).where("points > 0")


def contact_facts(contacts: DataFrame) -> DataFrame:
    has = lambda *types: F.bool_or(F.col("type").isin(*types))
    return contacts.groupBy(KEY).agg(
        has("PHONE").alias("c_phone"), has("EMAIL").alias("c_email"), has("CONTACT_FORM").alias("c_form"),
        has("WHATSAPP").alias("c_chat"), has("CONTACT_PAGE").alias("c_page"), has(*SOCIAL_TYPES).alias("c_social"),
    )


def contact_score(facts: DataFrame) -> DataFrame:
    part = lambda name, n: F.when(F.col(name), n).otherwise(0)
    total = (part("c_phone", 40) + part("c_email", 25) + part("c_form", 10) + part("c_chat", 10)
             + part("c_page", 5) + part("c_social", 10))
    return facts.select(KEY, total.cast("bigint").alias("contact_score"))


def evidence_confidence() -> Column:
    """0-100, over the wide row of a business."""
    reliability = _lookup(WEBSITE_FIELD_RELIABILITY, F.col("provider_key"))
    status = F.col("website_status")
    by_status = (
        F.when(
            status == "SIN_WEB",
            F.when(F.col("third").isNotNull() | F.col("search_checked"), 30)
            .when(reliability >= S.RELIABLE_PROVIDER, 20)
            .otherwise(0),
        )
        .when(status == "WEB_CAIDA", F.when(F.col("sure_down"), 35).otherwise(20))
        .when(status == "WEB_NO_VERIFICABLE", 0)
        .when(F.col("analysis_complete").isNotNull(), F.when(F.col("analysis_complete"), 35).otherwise(15))
        .otherwise(0)
    )
    reviews = F.when(F.col("reviews_analyzed") >= 3, 10).otherwise(0)
    listing = F.when(F.col("user_rating_count").isNotNull() | F.col("national_phone").isNotNull(), 10).otherwise(0)
    return F.least(F.lit(100), 35 + by_status + reviews + listing)


def score_notes() -> Column:
    """Fixed remarks on what the score does not use (array, over the wide row)."""
    return F.array_compact(F.array(
        F.when(F.col("website_status") == "WEB_NO_VERIFICABLE",
               "La web no se ha podido verificar: no suma puntos de oportunidad web."),
        F.when(F.col("user_rating_count").isNull(),
               "Actividad de clientes no disponible en este proveedor (no suma ni resta)."),
        F.lit("La valoración media (estrellas) no se usa en el score: calidad del negocio ≠ oportunidad de mejora "
              "digital."),
    ))


def provider_label(provider_key: Column) -> Column:
    return F.coalesce(_lookup(PROVIDER_LABEL, provider_key), F.lit("OpenStreetMap"))
