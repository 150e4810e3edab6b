"""Opportunity scores in one pass: a business's findings as one list, its points by array functions, no shuffle but those by business.

Findings are deduped first, so a list holds at most one entry per rule code. Lists are in order of severity and place; points are
given greedily down a list until its cap is used up. A business without findings or contacts is scored on its listing alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import literal_array, lookup
from ..rules import scoring as S
from ..rules.categories import CATEGORIES
from ..rules.recommendations import THIRD_PARTY_CODES
from ..rules.vocab import CONSISTENCY_CATEGORIES, CONTENT_CATEGORIES, TECHNICAL_CATEGORIES, WEBSITE_FIELD_RELIABILITY
from . import scoring as SC
from .weights import REST, Weights

KEY = "business_id"
_LISTING = [
    KEY, "website_status", "provider_key", "category_key", "business_status", "user_rating_count", "national_phone", "search_checked",
    "analysis_complete", "reviews_analyzed", "technical_score", "consistency_score",
]
_FINDING = ["sev_rank", "seq", "code", "severity", "category", "title", "description", "confidence", "provenance"]
_PART = "array<struct<ord: bigint, component: string, points: double, reason: string, codes: string, inferred: boolean>>"
_CAPPED = "array<struct<finding: {f}, place: bigint, raw: double, points: double>>"
ISSUES = {
    "technical_issue_count": TECHNICAL_CATEGORIES,
    "content_issue_count": CONTENT_CATEGORIES,
    "consistency_issue_count": CONSISTENCY_CATEGORIES,
}
_FLAGS = ["c_phone", "c_email", "c_form", "c_chat", "c_page", "c_social"]


def finding_lists(findings: DataFrame) -> DataFrame:
    """(business_id, found): the deduped findings of a business, worst first; at most one per rule code."""
    return findings.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct(*_FINDING))).alias("found"))


def _wide(business: DataFrame, findings: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row per business with its findings and what the score asks of them and of its contacts."""
    joined = business.select(*_LISTING).join(finding_lists(findings), KEY, "left").join(SC.contact_facts(contacts), KEY, "left")
    empty = F.array().cast(joined.schema["found"].dataType)
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    listed = joined.select(*_LISTING, F.coalesce("found", empty).alias("found"), *[no(c) for c in _FLAGS])
    down = lambda f: (f["category"] == "AVAILABILITY") & (f["severity"] == "CRITICAL")
    has = lambda *codes: F.exists("found", lambda f: f["code"].isin(*codes))
    first = lambda test: F.get(F.filter("found", test), F.lit(0))
    needs = {c.key: (c.needs_booking, c.needs_menu, c.label_es) for c in CATEGORIES}
    of_category = lambda i: lookup({k: v[i] for k, v in needs.items()}, F.col("category_key"))
    return listed.select(
        "*",
        first(lambda f: f["code"].isin(THIRD_PARTY_CODES)).alias("third"),
        first(down).alias("cause"),
        F.coalesce(F.exists("found", lambda f: down(f) & (f["confidence"] == "HIGH")), F.lit(False)).alias("sure_down"),
        has("NO_ONLINE_BOOKING").alias("no_booking"), has("REVIEW_ONLINE_BOOKING").alias("review_booking"),
        has("NO_MENU", "MENU_PDF_ONLY").alias("no_menu"), has("PROBABLE_PUBLIC_ENTITY").alias("public_entity"),
        F.coalesce(of_category(0), F.lit(False)).alias("needs_booking"), F.coalesce(of_category(1), F.lit(False)).alias("needs_menu"),
        F.coalesce(of_category(2), F.lit("")).alias("category_label"),
        F.coalesce(F.col("website_status").isin("SIN_WEB", "WEB_CAIDA"), F.lit(False)).alias("no_site"),
        F.coalesce("user_rating_count", F.lit(0)).alias("reviews"),
        *[_issues(categories).alias(name) for name, categories in ISSUES.items()],
    )


def _issues(categories: list[str]) -> Column:
    real = F.filter("found", lambda f: (f["severity"] != "INFO") & f["category"].isin(categories))
    return F.size(real).cast("bigint")


def _capped(found: Column, kind: str, keep, raw, place, cap: Column) -> Column:
    """Findings that ``keep``, by ``place`` (ties: worst first), with the points the cap still leaves them."""
    rows = F.transform(F.filter(found, keep), lambda f: F.struct(
        place(f).alias("place"), f["sev_rank"].alias("sev_rank"), f["seq"].alias("seq"), f.alias("finding"), raw(f).alias("raw")))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(_CAPPED.format(f=kind)).alias("rows"))

    def add(done: Column, r: Column) -> Column:
        points = F.least(r["raw"], F.greatest(cap - done["used"], F.lit(0.0)))
        row = F.struct(r["finding"], r["place"].cast("bigint").alias("place"), r["raw"], points.alias("points"))
        return F.struct((done["used"] + r["raw"]).alias("used"), F.concat(done["rows"], F.array(row)).alias("rows"))

    every = F.aggregate(F.sort_array(F.filter(rows, lambda r: r["raw"] > 0)), start, add, lambda done: done["rows"])
    return F.filter(every, lambda r: r["points"] > 0)


def _part(ord_: Column, component: str, points: Column, reason: Column, codes: Column, inferred: Column) -> Column:
    return F.struct(
        ord_.cast("bigint").alias("ord"), F.lit(component).alias("component"), points.cast("double").alias("points"),
        reason.alias("reason"), codes.cast("string").alias("codes"), inferred.alias("inferred"))


def _listing_parts(w: Weights) -> Column:
    """Points from the listing, its contacts and its category."""
    c, lit, yes, no, none = F.col, F.lit, F.lit(True), F.lit(False), F.lit(None).cast("string")
    booking = c("needs_booking") & (c("no_site") | c("no_booking") | c("review_booking"))
    menu = ~booking & c("needs_menu") & (c("no_site") | c("no_menu"))
    at = lambda block: lit(block * 1_000_000)
    text = lambda *parts: F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])
    presence = w.tier("presence", c("reviews"))
    worth = lambda kind, key: lit(w.points(kind, key))
    cells = [
        (c("website_status") == "SIN_WEB", _part(
            at(0), "website", worth("status", "SIN_WEB"),
            F.coalesce(text("Sin web propia (", F.lower("third.title"), ")"), lit("No se ha encontrado web oficial")),
            F.coalesce("third.code", lit("NO_WEBSITE")), no)),
        (c("website_status") == "WEB_CAIDA", _part(
            at(0), "website", worth("status", "WEB_CAIDA"),
            text("La web publicada no funciona", F.coalesce(text(" (", F.lower("cause.description"), ")"), lit(""))), c("cause.code"), no)),
        (presence > 0, _part(
            at(5), "presence", presence,
            text("Negocio con actividad de clientes (", c("reviews").cast("string"), " reseñas en ",
                 F.when(c("provider_key") == "google_places", "Google").otherwise("el proveedor"), ")"), none, no)),
        (c("c_phone"), _part(at(6), "contact", worth("contact", "phone"), lit("Teléfono disponible"), none, no)),
        (c("c_email"), _part(at(7), "contact", worth("contact", "email"), lit("Email empresarial publicado"), none, no)),
        (c("c_form") | c("c_chat"), _part(
            at(8), "contact", worth("contact", "form_or_chat"),
            F.when(c("c_chat"), "WhatsApp publicado").otherwise("Formulario de contacto"), none, no)),
        (booking, _part(
            at(9), "need", worth("need", "booking"),
            text("Categoría que suele depender de reservas/citas online (", c("category_label"), ")"),
            F.when(c("no_booking"), "NO_ONLINE_BOOKING"), yes)),
        (menu, _part(
            at(9), "need", worth("need", "menu"),
            text("Categoría en la que la carta/menú online es clave (", c("category_label"), ")"), none, yes)),
        (c("business_status") == "CLOSED_TEMPORARILY", _part(
            at(10), "penalty", worth("penalty", "CLOSED_TEMPORARILY"), lit("Cerrado temporalmente según el proveedor"), none, no)),
    ]
    return F.array_compact(F.array(*[F.when(test, part) for test, part in cells]))


def _finding_parts(w: Weights) -> Column:
    """Points of website, consistency and review findings, from their capped lists."""
    inferred = lambda r: r["finding"]["provenance"] == "INFERRED"

    def each(rows: Column, block: int, component: str, points, place, doubtful) -> Column:
        return F.transform(rows, lambda r, i: _part(
            F.lit(block * 1_000_000) + place(r, i), component, points(r), r["finding"]["title"], r["finding"]["code"], doubtful(r)))

    web = F.col("web")
    low = F.filter(web, lambda r: r["finding"]["severity"] == "LOW")
    by_seq = F.sort_array(F.transform(low, lambda r: F.struct(r["finding"]["seq"], r["finding"]["code"].alias("code"))))
    minor = _part(
        F.lit(2_000_000), "website", F.least(F.round(F.size(low) * F.lit(w.points("severity", "LOW")), 1), F.col("web_cap")),
        F.concat(F.size(low).cast("string"), F.lit(" mejora(s) menor(es) (SEO/UX)")),
        F.array_join(F.transform(by_seq, lambda r: r["code"]), ","), F.lit(False))
    return F.concat(
        each(F.filter(web, lambda r: r["finding"]["severity"] != "LOW"), 1, "website", lambda r: F.round(r["points"], 1),
             lambda r, i: i + 1, inferred),
        F.when(F.size(low) > 0, F.array(minor)).otherwise(F.array().cast(_PART)),
        each(F.col("consistent"), 3, "consistency", lambda r: r["points"], lambda r, i: r["place"], inferred),
        each(F.col("reviewed"), 4, "consistency", lambda r: r["points"], lambda r, i: i + 1, lambda r: F.lit(True)))


def scorecard(business: DataFrame, findings: DataFrame, contacts: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per business: its score columns, issue counts and ``parts``, every contribution in explanation order.

    ``findings`` are deduped. Two shuffles beyond those of the dedupe, by business: findings and contacts, both aggregated first.
    """
    w = weights or Weights()
    wide = _wide(business, findings, contacts)
    kind = wide.schema["found"].dataType.elementType.simpleString()
    counted = lambda f: f["category"].isin(TECHNICAL_CATEGORIES + CONTENT_CATEGORIES) | (f["code"] == "FREE_SUBDOMAIN")
    severity = lambda f: F.coalesce(w.by("severity", f["severity"]), F.lit(0.0))
    consistency = literal_array(w.of("consistency"))
    review = lambda f: F.coalesce(w.by("review", f["code"]), F.lit(w.points("review", REST)))
    web_cap = F.when(F.col("website_status").isin("WEB_ACEPTABLE", "WEB_FUNCIONAL_CON_PROBLEMAS"), w.by("cap", F.col("website_status")))
    found = F.col("found")
    lists = wide.withColumn("web_cap", web_cap).withColumns({
        "web": F.when(F.col("web_cap").isNotNull(), _capped(found, kind, counted, severity, lambda f: -severity(f), F.col("web_cap"))).otherwise(
            F.array().cast(_CAPPED.format(f=kind))),
        "consistent": _capped(
            found, kind, lambda f: F.array_contains(consistency, f["code"]), lambda f: w.by("consistency", f["code"]),
            lambda f: lookup(w.places("consistency"), f["code"]), F.lit(w.points("cap", "consistency"))),
        "reviewed": _capped(found, kind, lambda f: f["category"] == "REVIEWS", review, lambda f: F.lit(0), F.lit(w.points("cap", "review"))),
    })
    parts = F.filter(F.concat(_listing_parts(w), _finding_parts(w)), lambda p: p["points"] != 0)
    total = lambda test: F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.when(test(p), p["points"]).otherwise(0.0))
    summed = lists.withColumn("parts", parts).drop("web", "consistent", "reviewed", "found").withColumns({
        "raw_total": total(lambda p: F.lit(True)), "website_points": total(lambda p: p["component"] == "website"),
        "gone": F.coalesce(F.col("business_status") == "CLOSED_PERMANENTLY", F.lit(False)),
    })
    closing = _part(F.lit(11_000_000), "penalty", -F.col("raw_total"), F.lit("Cerrado permanentemente según el proveedor"),
                    F.lit(None), F.lit(False))
    points = lambda name, n: F.when(F.col(name), n).otherwise(0)
    scored = summed.select(
        "*", F.when(F.col("gone"), F.lit(0)).otherwise(_clamp(F.col("raw_total"))).cast("bigint").alias("score"),
        SC.evidence_confidence().cast("bigint").alias("sure"),
        (points("c_phone", 40) + points("c_email", 25) + points("c_form", 10) + points("c_chat", 10) + points("c_page", 5)
         + points("c_social", 10)).cast("bigint").alias("reachable"))
    return scored.select(
        # never NULL, and known to be: a later test for NULL is then dropped instead of pushed down with the whole computation
        KEY, F.coalesce("score", F.lit(0).cast("bigint")).alias("opportunity_score"), _level(w).alias("decision"),
        _clamp(F.col("website_points") / w.points("cap", "website") * 100).alias("website_opportunity"),
        "technical_score", "consistency_score", F.col("reachable").alias("contact_score"), F.col("sure").alias("evidence_confidence"),
        F.sort_array(F.when(F.col("gone") & (F.col("raw_total") != 0), F.concat("parts", F.array(closing))).otherwise(F.col("parts"))).alias("parts"),
        *ISSUES,
    ).select(KEY, "opportunity_score", F.col("decision.level").alias("opportunity_level"), F.col("decision.why").alias("level_reason"),
             "website_opportunity", "technical_score", "consistency_score", "contact_score", "evidence_confidence", "parts", *ISSUES)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(c, 0))).cast("bigint")


def _level(w: Weights) -> Column:
    """struct<level, why> of a scored row; the first reason that holds."""
    score, sure = F.col("score"), F.col("sure")
    high, medium, least = (w.points("level", k) for k in ("HIGH", "MEDIUM", "confidence"))
    unproven = ((F.col("website_status") == "SIN_WEB") & F.col("third").isNull() & ~F.col("search_checked")
                & (lookup(WEBSITE_FIELD_RELIABILITY, F.col("provider_key")) < S.RELIABLE_PROVIDER))
    unseen = F.coalesce(F.col("website_status") == "WEB_NO_VERIFICABLE", F.lit(False)) & (score < high)
    out = lambda level, *why: F.struct(F.lit(level).alias("level"), F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in why]).alias("why"))
    return (
        F.when(F.col("gone"), out("LOW", "Negocio cerrado permanentemente según el proveedor"))
        .when(F.col("public_entity"), out(
            "LOW", "Posible entidad pública (inferido por el nombre): no suele ser un cliente de este tipo de servicios"))
        .when(F.coalesce(unproven, F.lit(False)), out(
            "INSUFFICIENT_EVIDENCE", "La ausencia de web se basa solo en un proveedor con datos de web incompletos (p. ej. OpenStreetMap) y no "
            "se ha contrastado con buscador. Verifícalo manualmente o configura un buscador / Google Places."))
        .when(sure < least, out("INSUFFICIENT_EVIDENCE", "Confianza de la evidencia ", sure, f" < {least:g}"))
        .when(unseen, out("INSUFFICIENT_EVIDENCE", "No se ha podido verificar la web y el resto de señales no bastan para una prioridad alta"))
        .when(score >= high, out("HIGH", "Score ", score, f" ≥ {high:g}"))
        .when(score >= medium, out("MEDIUM", "Score ", score, f" entre {medium:g} y {high - 1:g}"))
        .otherwise(out("LOW", "Score ", score, f" < {medium:g}")))


def contributions(cards: DataFrame) -> DataFrame:
    """One row per contribution of every business.

    Opened with empty lists kept and dropped after: else the test for empty ones is pushed below and computes the lists twice.
    """
    return cards.select(KEY, F.explode_outer("parts").alias("part")).where(F.col("part").isNotNull()).select(KEY, "part.*")


def reason(limit: int = 3) -> Column:
    """The strongest positive contributions of a card as one text, NULL where there is none."""
    positive = F.filter("parts", lambda p: p["points"] > 0)
    best = F.slice(F.sort_array(F.transform(positive, lambda p: F.struct(
        (-p["points"]).alias("loss"), p["ord"], p["points"], p["reason"]))), 1, limit)
    text = F.transform(best, lambda p: F.concat(F.lit("+"), F.round(p["points"], 0).cast("bigint").cast("string"), F.lit(" "), p["reason"]))
    return F.when(F.size(positive) > 0, F.array_join(text, "; "))
