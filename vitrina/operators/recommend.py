"""Recommendations, listing-level findings, summary text and open notes of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.literals import literal_map as _map
from ..functions.text import public_entity
from ..rules.categories import CATEGORIES
from ..rules.recommendations import HIDDEN_WITHOUT_SITE, NEW_SITE_OFFERS, REC_RULES, THIRD_PARTY_CODES
from ..rules.vocab import PROVIDER_LABEL, WEBSITE_FIELD_RELIABILITY, WEBSITE_STATUS_LABEL
from .findings import finding

KEY = "business_id"


def rule_table(spark) -> DataFrame:
    """(place, trigger place, code, product, title, trigger): one row per trigger, about eighty rows in all."""
    rows = [
        (i, k, r.code, r.product, r.title, trig)
        for i, r in enumerate(REC_RULES) for k, trig in enumerate(r.triggers)
    ]
    return spark.createDataFrame(
        rows, "place int, trigger_place int, rec_code string, product string, rec_title string, code string"
    )


def recommend(business: DataFrame, findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Offers per business from its deduped findings, most urgent first.

    The rule table is a fixed catalogue of under a hundred rows, hence the broadcast.
    """
    rules = rules if rules is not None else rule_table(business.sparkSession)
    hits = findings.select(KEY, "code", "sev_rank").join(F.broadcast(rules), "code")
    from_rules = hits.groupBy(KEY, "place", "rec_code", "product", "rec_title").agg(
        F.least(F.lit(5), F.min("sev_rank") + 1).alias("priority"),
        F.array_join(
            F.transform(F.sort_array(F.collect_set(F.struct("trigger_place", "code"))), lambda r: r["code"]), ","
        ).alias("triggered_by"),
    )
    in_order = F.struct("sev_rank", "seq")
    third = findings.where(F.col("code").isin(THIRD_PARTY_CODES)).groupBy(KEY).agg(
        F.min_by("code", in_order).alias("third_code")
    )
    status = business.select(KEY, "website_status", "category_key")
    no_site = F.coalesce(F.col("website_status") == "SIN_WEB", F.lit(False))
    kept = (
        from_rules.join(status, KEY)
        .where(~(no_site & F.col("rec_code").isin(HIDDEN_WITHOUT_SITE)))
        .select(KEY, (F.col("place") + 100).alias("place"), F.col("rec_code").alias("code"), "product",
                F.col("rec_title").alias("title"), "priority", "triggered_by")
    )
    needs = {
        "booking": _map({c.key: c.needs_booking for c in CATEGORIES})[F.col("category_key")],
        "menu": _map({c.key: c.needs_menu for c in CATEGORIES})[F.col("category_key")],
    }
    offers = F.array_compact(F.array(*[
        F.when(
            F.coalesce(needs[need], F.lit(False)) if need else F.lit(True),
            F.struct(F.lit(i).alias("place"), F.lit(code).alias("code"), F.lit(product).alias("product"),
                     F.lit(title).alias("title"), F.lit(priority).alias("priority")),
        )
        for i, (code, product, title, priority, need) in enumerate(NEW_SITE_OFFERS)
    ]))
    fresh = (
        status.where(no_site).join(third, KEY, "left")
        .select(KEY, F.coalesce("third_code", F.lit("NO_WEBSITE")).alias("triggered_by"), F.inline(offers))
        .select(KEY, "place", "code", "product", "title", "priority", "triggered_by")
    )
    w = Window.partitionBy(KEY).orderBy("priority", "place")
    return kept.unionByName(fresh).withColumn("position", F.row_number().over(w))


def listing_rules(no_site: Column, search_checked: Column, reason: Column) -> list[tuple[Column, Column]]:
    """Findings about the listing itself, for :func:`operators.findings.emit`."""
    reliability = _map(WEBSITE_FIELD_RELIABILITY)[F.col("provider_key")]
    confidence = F.when(search_checked, "HIGH").when(reliability >= 0.7, "MEDIUM").otherwise("LOW")
    status = F.col("business_status")
    return [
        (no_site, finding("NO_WEBSITE", "HIGH", confidence=confidence, description=reason)),
        (public_entity(F.col("name")),
         finding("PROBABLE_PUBLIC_ENTITY", "INFO", provenance="INFERRED", confidence="MEDIUM",
                 evidence=F.col("name"))),
        (status == "CLOSED_PERMANENTLY",
         finding("BUSINESS_CLOSED_PERMANENTLY", "INFO", provenance="OBSERVED", evidence=status)),
        (status == "CLOSED_TEMPORARILY",
         finding("BUSINESS_CLOSED_TEMPORARILY", "INFO", provenance="OBSERVED", evidence=status)),
    ]


def analysis_status(errors: Column, complete: Column) -> Column:
    return F.when((errors > 0) | ~F.coalesce(complete, F.lit(True)), "PARTIAL").otherwise("COMPLETED")


def summary(business: DataFrame, findings: DataFrame) -> DataFrame:
    """One readable sentence group per business (needs ``status_reason``)."""
    serious = F.col("severity").isin("CRITICAL", "HIGH") & ~F.col("code").isin("NO_WEBSITE", "WEBSITE_IS_THIRD_PARTY")
    facts = findings.groupBy(KEY).agg(
        F.sort_array(F.collect_list(F.when(serious, F.struct("sev_rank", "seq", "title")))).alias("serious"),
        F.count_if(F.col("category").isin("CONSISTENCY", "FRESHNESS")).alias("doubts"),
    )
    label = _map(WEBSITE_STATUS_LABEL)[F.col("website_status")]
    top = F.array_join(F.transform(F.slice("serious", 1, 3), lambda r: F.lower(r["title"])), "; ")
    pname = F.coalesce(_map(PROVIDER_LABEL)[F.col("provider_key")], F.lit("OpenStreetMap"))
    text = F.concat_ws(
        " ",
        F.concat(label, F.lit(": "), F.col("status_reason"), F.lit(".")),
        F.when(F.size("serious") > 0, F.concat(F.lit("Problemas importantes: "), top, F.lit("."))),
        F.when(
            F.col("doubts") > 0,
            F.concat(F.lit("Señales de información posiblemente desactualizada o inconsistente: "),
                     F.col("doubts").cast("string"), F.lit(".")),
        ),
        F.when(
            F.col("user_rating_count") > 0,
            F.concat(F.col("user_rating_count").cast("string"), F.lit(" reseñas en "), pname, F.lit(".")),
        ),
    )
    return business.join(facts, KEY, "left").select(*business.columns, text.alias("summary"))


def unverified_notes(business: DataFrame, contact_facts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """What could not be verified, one distinct note per row; ``more`` are notes (business_id, note) of other steps."""
    no_site = F.coalesce(F.col("website_status") == "SIN_WEB", F.lit(False))
    notes = F.array_compact(F.array(
        F.when(~F.coalesce("c_email", F.lit(False)),
               "Email empresarial: no encontrado en fuentes públicas (no se generan emails por patrón)."),
        F.when(~F.coalesce("c_phone", F.lit(False)), "Teléfono: no encontrado."),
        F.when(
            F.col("reviews_analyzed") == 0,
            F.when(F.col("provider_key") == "google_places",
                   "Reseñas: no disponibles para este negocio o no solicitadas (GOOGLE_PLACES_FETCH_REVIEWS).")
            .otherwise("Reseñas: el proveedor utilizado no ofrece reseñas."),
        ),
        F.when(no_site & ~F.col("search_checked"),
               "No se ha comprobado en buscadores si existe una web no enlazada en la ficha (SEARCH_PROVIDER no "
               "configurado)."),
    ))
    rows = business.join(contact_facts, KEY, "left").select(KEY, F.explode(F.array_distinct(notes)).alias("note"))
    return rows if more is None else rows.unionByName(more.select(KEY, "note")).distinct()
