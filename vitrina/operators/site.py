"""Website audit: fetch outcome, gates, rule families and final status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.literals import literal_map as _map
from ..rules import patterns as P
from ..rules.platforms import PARKING_HOSTS
from ..rules.regex import java
from ..sources.captures import is_html
from . import pages as PG
from .findings import emit, finding, severity_counts, technical_score

_RETRY_SLOW = ["TIMEOUT", "DNS_TEMPORARY", "CONNECTION_RESET"]
_TRY_OTHER = ["CONNECTION_REFUSED", "TIMEOUT", "CONNECTION_RESET", "HOST_UNREACHABLE", "TLS_ERROR"]


def attempts_by_site(captures: DataFrame, key: str) -> DataFrame:
    """One row per site with its fetch attempts side by side (a site has a handful of attempts)."""
    cols = [c for c in captures.columns if c not in (key, "purpose")]
    kinds = ["first", "insecure", "slow", "other_protocol", "www", "again"]
    return captures.groupBy(key).agg(*[
        F.min_by(F.when(F.col("purpose") == k, F.struct(*cols)), F.when(F.col("purpose") == k, F.col("attempt"))).alias(k)
        for k in kinds
    ])


def capture_outcome(captures: DataFrame, key: str) -> DataFrame:
    """What the home-page fetch amounts to: ``outcome`` ok/down/unverifiable, reason, code and the response used."""
    rows = attempts_by_site(captures, key)
    answered = lambda c: F.col(c).isNotNull() & F.col(f"{c}.error_code").isNull()
    first_error = F.col("first.error_code")
    retried = (
        F.when(first_error == "TLS_ERROR", F.coalesce("insecure", "first"))
        .when(first_error.isin(_RETRY_SLOW), F.coalesce("slow", "first"))
        .otherwise(F.col("first"))
    )
    rows = rows.withColumn("r2", retried)
    use_other = F.col("r2.error_code").isin(_TRY_OTHER) & answered("other_protocol")
    use_www = (F.col("r2.error_code") == "DNS_NOT_FOUND") & answered("www")
    rows = rows.withColumns({
        "r3": F.when(use_other, F.col("other_protocol")).when(use_www, F.col("www")).otherwise(F.col("r2")),
        "https_dead": F.coalesce(use_other & F.col("first.requested_url").startswith("https:"), F.lit(False)),
        "tls_failed": F.coalesce((first_error == "TLS_ERROR"), F.lit(False)),
        "policy_block": F.coalesce(first_error == "SSRF_BLOCKED", F.lit(False)),
    })
    again = F.col("r3.error_code").isNull() & (F.col("r3.status") >= 500) & answered("again")
    rows = rows.withColumn("res", F.when(again, F.col("again")).otherwise(F.col("r3")))
    err, status = F.col("res.error_code"), F.col("res.status")
    body = F.coalesce("res.html", F.lit(""))
    challenge = body.rlike(java(P.CHALLENGE))
    if "headers" in captures.columns:  # header names are in lower case, as fetched
        challenge = challenge | F.coalesce(F.col("res.headers")["cf-mitigated"] != "", F.lit(False))
    challenge = status.isin(403, 503, 429) & challenge
    http = F.concat(F.lit("HTTP "), status.cast("string"))
    verdict = lambda outcome, reason, code: F.struct(
        F.lit(outcome).alias("outcome"), reason.cast("string").alias("reason"), code.cast("string").alias("code"))
    http_code = F.concat(F.lit("HTTP_"), status.cast("string"))
    known = _map(P.UNREACHABLE_REASON)[err]
    decided = (
        F.when(F.col("policy_block"), verdict("unverifiable", F.lit("Bloqueado por la política de seguridad"), F.lit("SSRF_BLOCKED")))
        .when(known.isNotNull(), verdict("down", known, err))
        .when(err.isNotNull(), verdict("unverifiable", F.lit("No se ha podido comprobar la web"), err))
        .when(challenge, verdict("unverifiable", F.lit("La web tiene una protección anti-bots que impide el análisis automático"), http_code))
        .when(status.isin(401, 403, 407, 429, 451), verdict("unverifiable", F.concat(F.lit("La web deniega el acceso automatizado ("), http, F.lit(")")), http_code))
        .when(status >= 500, verdict("down", F.concat(F.lit("Error del servidor ("), http, F.lit(") en varios intentos")), http_code))
        .when(status.isin(404, 410), verdict("down", F.concat(F.lit("La portada no existe ("), http, F.lit(")")), http_code))
        .when((status < 200) | (status >= 400), verdict("unverifiable", F.concat(F.lit("Respuesta inesperada ("), http, F.lit(")")), http_code))
        .when(body == "", verdict("down", F.lit("La web responde sin contenido"), F.lit("EMPTY")))
        .otherwise(verdict("ok", F.lit(None), F.lit(None)))
    )
    return rows.select(
        key, decided.alias("d"), "res", "https_dead", "tls_failed", F.col("first.error_detail").alias("tls_detail"),
        F.col("first.requested_url").alias("requested_url"),
    ).select(key, "d.*", "res", "https_dead", "tls_failed", "tls_detail", "requested_url")


def gates(outcomes: DataFrame, key: str) -> DataFrame:
    """The first reason to stop before content rules, NULL when the site is open for analysis."""
    asked, final = U.website_parts(F.col("requested_url")), U.parse(F.col("res.url"))
    df = outcomes.withColumns({"asked": asked, "final": final})
    df = df.withColumns({
        "platform": U.platform(F.col("asked.host"), F.col("asked.path")),
        "final_platform": U.platform(F.col("final.host"), F.col("final.path")),
        "other_domain": U.registrable_domain(F.col("asked.host")) != U.registrable_domain(F.col("final.host")),
    })
    kind, final_kind = F.col("platform.kind"), F.col("final_platform.kind")
    parked = reduce(lambda a, b: a | b, [F.col("final.host").endswith(h) for h in PARKING_HOSTS])
    gate = (
        F.when(F.col("asked").isNull(), "url_invalid")
        .when(U.is_not_own_site(kind), "third_party")
        .when(F.coalesce(kind == "DISCONTINUED_BUILDER", F.lit(False)), "discontinued")
        .when(F.col("outcome") == "down", "down")
        .when(F.col("outcome") == "unverifiable", "unverifiable")
        .when(U.is_not_own_site(final_kind), "redirect_third_party")
        .when(F.coalesce(parked, F.lit(False)), "parking_host")
        .when(~is_html(F.col("res.content_type")), "not_html")
        .when(~F.coalesce("res.robots_allowed", F.lit(True)), "robots")
    )
    return df.withColumn("gate", gate)


def network_rules() -> list[tuple[Column, Column]]:
    """Rules about reaching the site, over the rows of :func:`gates`."""
    gate, detail = F.col("gate"), F.upper(F.coalesce("tls_detail", F.lit("")))
    reached = gate.isNull() | ~gate.isin("url_invalid", "third_party")
    is_gate = lambda g: F.coalesce(gate == g, F.lit(False))
    answered = gate.isNull() | gate.isin("not_html", "robots")
    tls = F.col("tls_failed") & reached
    kind = F.col("platform.kind")
    down = reached & (F.col("outcome") == "down")
    cases, earlier = [], F.lit(False)
    for pattern, code, severity in P.TLS_CASES:
        cases.append((tls & detail.rlike(pattern) & ~earlier, finding(code, severity, evidence=F.col("tls_detail"))))
        earlier = earlier | detail.rlike(pattern)
    return [
        (is_gate("url_invalid"), finding("WEBSITE_URL_INVALID", "HIGH", evidence=F.col("requested_url"))),
        (is_gate("third_party"), finding("WEBSITE_IS_THIRD_PARTY", "HIGH", value=F.col("platform.label"), evidence=F.col("requested_url"))),
        (reached & (kind == "DISCONTINUED_BUILDER"), finding("GOOGLE_BUSINESS_SITE_DISCONTINUED", "CRITICAL", provenance="OBSERVED")),
        (reached & (kind == "FREE_SUBDOMAIN_BUILDER"), finding("FREE_SUBDOMAIN", "MEDIUM", evidence=F.col("asked.host"))),
        *cases,
        (tls & ~earlier, finding("TLS_ERROR", "HIGH", evidence=F.col("tls_detail"))),
        (reached & F.col("https_dead"), finding("HTTPS_NOT_WORKING", "HIGH")),
        (down & ~F.col("code").rlike("^(HTTP_|EMPTY)"),
         finding("WEBSITE_UNREACHABLE", "CRITICAL", description=F.col("reason"),
                 confidence=F.when(F.col("code") == "TIMEOUT", "MEDIUM").otherwise("HIGH"))),
        (down & F.col("code").startswith("HTTP_"), finding("WEBSITE_HTTP_ERROR", "CRITICAL", description=F.col("reason"))),
        (down & (F.col("code") == "EMPTY"), finding("EMPTY_RESPONSE", "CRITICAL")),
        (is_gate("redirect_third_party"), finding("DOMAIN_REDIRECTS_TO_THIRD_PARTY", "HIGH", value=F.col("final_platform.label"))),
        (is_gate("parking_host"), finding("DOMAIN_PARKED", "CRITICAL", evidence=F.col("res.url"))),
        (answered & F.col("other_domain"),
         finding("REDIRECTS_TO_OTHER_DOMAIN", "LOW", provenance="OBSERVED", confidence="MEDIUM", evidence=F.col("final.host"))),
        (is_gate("robots"), finding("ROBOTS_BLOCKS_ANALYSIS", "INFO")),
    ]


def probe_facts(probes: DataFrame, key: str) -> DataFrame:
    """Counts over link, image and resource probes of a site, in one combined aggregate."""
    broken = is_broken()
    of = lambda k: F.col("target_kind") == k
    size = F.coalesce("bytes", F.lit(0))
    return probes.groupBy(key).agg(
        F.count_if(of("link") & broken).alias("broken_links"),
        F.count_if(of("image") & broken).alias("broken_images"),
        F.count_if(of("resource") & broken).alias("broken_resources"),
        F.count_if(of("resource") & F.col("is_script") & broken).alias("broken_scripts"),
        F.count_if(of("resource") & F.col("is_script")).alias("own_scripts"),
        F.count_if(of("domain") & (F.col("error") == "DNS_NOT_FOUND")).alias("dead_domains"),
        F.count_if(of("image") & (size > 1_000_000)).alias("heavy_images"),
        F.sum(F.when(of("image"), size).otherwise(0)).alias("image_bytes"),
        F.sum(F.when(of("resource"), size).otherwise(0)).alias("resource_bytes"),
        F.count_if(of("link")).alias("links_checked"),
    )


def is_broken() -> Column:
    s = F.col("status")
    return F.coalesce(F.col("error").isin("DNS_NOT_FOUND", "CONNECTION_REFUSED"), F.lit(False)) | F.coalesce(
        s.isin(404, 410) | ((s >= 500) & (s != 503)), F.lit(False)
    )


def security_rules() -> list[tuple[Column, Column]]:
    plain = F.col("final.scheme") == "http"
    available = F.coalesce("res.https_available", F.lit(False))
    days = F.col("res.tls_days_left")
    return [
        (plain & available, finding("HTTPS_NOT_ENFORCED", "MEDIUM")),
        (plain & ~available & ~F.col("https_dead"), finding("NO_HTTPS", "HIGH")),
        (~plain & (F.col("res.http_redirects_https") == F.lit(False)), finding("HTTP_NOT_REDIRECTED", "LOW")),
        (~plain & days.between(0, 20), finding("TLS_CERT_EXPIRING", "MEDIUM", value=days)),
        (F.col("res.redirects") > 3, finding("EXCESSIVE_REDIRECTS", "LOW")),
    ]


def performance_rules() -> list[tuple[Column, Column]]:
    ms = F.col("res.total_ms")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [
        (ms > 6000, finding("SLOW_RESPONSE", "HIGH", catalog_key="SLOW_RESPONSE_HIGH", evidence=ms)),
        ((ms > 3000) & (ms <= 6000), finding("SLOW_RESPONSE", "MEDIUM", evidence=ms)),
        (F.octet_length("res.html") > 1_500_000, finding("LARGE_HTML", "LOW")),
        (n("heavy_images") > 0, finding("HEAVY_IMAGES", F.when(n("heavy_images") >= 3, "MEDIUM").otherwise("LOW"))),
        (n("broken_links") > 0, finding("BROKEN_INTERNAL_LINKS", F.when(n("broken_links") >= 3, "HIGH").otherwise("MEDIUM"), value=n("broken_links"))),
        (n("broken_images") > 0, finding("BROKEN_IMAGES", "MEDIUM", value=n("broken_images"))),
        (n("broken_resources") > 0, finding("MISSING_RESOURCES", "MEDIUM")),
        (n("dead_domains") > 0, finding("DEAD_EXTERNAL_DOMAINS", "MEDIUM", confidence="MEDIUM")),
        (~F.coalesce("res.favicon_ok", F.lit(False)), finding("NO_FAVICON", "LOW")),
    ]


def seo_rules() -> list[tuple[Column, Column]]:
    title = F.coalesce("title", F.lit(""))
    generic = title.rlike(java(P.GENERIC_TITLE)) | (F.length(title) < 8)
    return [
        (title == "", finding("MISSING_TITLE", "MEDIUM")),
        ((title != "") & generic, finding("GENERIC_TITLE", "LOW", evidence=title)),
        ((title != "") & ~generic & (F.length(title) > 70), finding("LONG_TITLE", "LOW", evidence=title)),
        (F.col("meta_description").isNull(), finding("MISSING_META_DESCRIPTION", "LOW")),
        (F.col("h1_count") == 0, finding("NO_H1", "LOW")),
        (F.col("h1_count") > 2, finding("MULTIPLE_H1", "INFO", value=F.col("h1_count"))),
        (F.col("lang").isNull(), finding("MISSING_LANG", "LOW")),
        (F.coalesce(F.col("robots_meta").rlike("noindex"), F.lit(False)), finding("NOINDEX", "HIGH", evidence=F.col("robots_meta"))),
        (~F.coalesce("local_schema", F.lit(False)), finding("NO_LOCAL_SCHEMA", "LOW", evidence=F.array_join("schema.types", ", "))),
    ]


def mobile_rules() -> list[tuple[Column, Column]]:
    view = F.coalesce("viewport", F.lit(""))
    frames = F.exists("deprecated_tags", lambda t: F.contains(t, F.lit("frame")))
    return [
        (view == "", finding("NO_VIEWPORT", "HIGH", provenance="INFERRED")),
        (F.col("fixed_viewport"), finding("FIXED_WIDTH_VIEWPORT", "HIGH", evidence=view)),
        ((view != "") & ~F.col("fixed_viewport") & T.has(view, P.NO_ZOOM), finding("ZOOM_DISABLED", "LOW", evidence=view)),
        (F.coalesce("res.horizontal_overflow", F.lit(False)), finding("HORIZONTAL_OVERFLOW", "HIGH")),
        (F.col("table_layout"), finding("TABLE_LAYOUT", "MEDIUM", provenance="INFERRED", confidence="MEDIUM")),
        (F.col("uses_flash"), finding("USES_FLASH", "HIGH")),
        (F.size("deprecated_tags") > 0, finding("DEPRECATED_HTML", F.when(frames, "HIGH").otherwise("LOW"), evidence=F.array_join("deprecated_tags", ", "))),
    ]


def accessibility_rules() -> list[tuple[Column, Column]]:
    counters = ["images_without_alt", "inputs_without_label", "links_without_text", "buttons_without_name"]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counters])
    images = F.size("images")
    serious = (images >= 3) & (F.col("images_without_alt") * 2 > images)
    return [(total > 0, finding(
        "ACCESSIBILITY_BASIC", F.when(serious, "MEDIUM").otherwise("LOW"),
        evidence=F.concat_ws(" / ", *[F.col(c).cast("string") for c in counters])))]


def tech_rules() -> list[tuple[Column, Column]]:
    major = lambda v: F.split_part(v, F.lit("."), F.lit(1)).try_cast("int")
    wp = major(F.col("wordpress_version"))
    gen = F.coalesce("generator", F.lit(""))
    errors = F.coalesce("res.console_errors", F.lit(0))
    mark = {"provenance": "INFERRED", "confidence": "MEDIUM"}
    return [
        ((wp > 0) & (wp < 6), finding("OUTDATED_CMS", "MEDIUM", value=F.col("wordpress_version"), **mark)),
        (gen.rlike(r"(?i)joomla!?\s*[12]\."), finding("OUTDATED_CMS", "MEDIUM", catalog_key="OUTDATED_CMS_JOOMLA", **mark)),
        (major(F.col("jquery")) < 3, finding("OUTDATED_JQUERY", "LOW", value=F.col("jquery"), **mark)),
        (F.size("mixed_content") > 0, finding("MIXED_CONTENT", "MEDIUM", evidence=F.array_join(F.slice("mixed_content", 1, 5), " "))),
        (errors > 0, finding("CONSOLE_ERRORS", F.when(errors >= 5, "MEDIUM").otherwise("LOW"))),
        (F.coalesce(F.col("placeholder") == "UNDER_CONSTRUCTION", F.lit(False)), finding("UNDER_CONSTRUCTION", "CRITICAL")),
        (F.coalesce(F.col("placeholder") == "PLACEHOLDER", F.lit(False)), finding("PLACEHOLDER_CONTENT", "HIGH")),
    ]


def content_rules() -> list[tuple[Column, Column]]:
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    phone, email, form, chat = (n(c) > 0 for c in ("phones", "emails", "contact_forms", "whatsapp"))
    silent = ~phone & ~email & ~form & ~chat
    tappable = F.coalesce(F.exists("phones", lambda p: p["clickable"]), F.lit(False))
    address = (n("address_texts") > 0) | (n("postal_codes") > 0) | yes("schema_street") | yes("schema_postal")
    hours = (n("hours_texts") > 0) | yes("schema_hours")
    all_pdf = F.coalesce(F.forall("menu_links", lambda m: m["is_pdf"]), F.lit(True))
    own_links = F.size(F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"]), lambda x: x["href"])))
    guess = {"provenance": "INFERRED", "confidence": "MEDIUM"}
    return [
        (F.col("word_count") < 30, finding("EMPTY_PAGE", "HIGH", evidence=F.col("word_count"))),
        ((F.col("word_count") >= 30) & (F.col("total_words") < 150), finding("THIN_CONTENT", "MEDIUM", evidence=F.col("total_words"))),
        (silent, finding("NO_CONTACT_METHOD", "HIGH")),
        (~silent & ~phone, finding("NO_PHONE_ON_SITE", "MEDIUM")),
        (phone & ~tappable, finding("PHONE_NOT_CLICKABLE", "LOW")),
        (F.size("cta_texts") == 0, finding("NO_CTA", "LOW", **guess)),
        (~address & ~yes("site_map"), finding("NO_ADDRESS_OR_MAP", "MEDIUM", confidence="MEDIUM")),
        (~hours, finding("NO_HOURS_ON_SITE", "LOW", confidence="MEDIUM")),
        (yes("needs_booking") & (n("booking_links") == 0), finding("NO_ONLINE_BOOKING", "MEDIUM", **guess)),
        (yes("needs_menu") & (n("site_menu_links") == 0), finding("NO_MENU", "MEDIUM", **guess)),
        (yes("needs_menu") & (n("site_menu_links") > 0) & all_pdf, finding("MENU_PDF_ONLY", "LOW", **guess)),
        (n("socials") == 0, finding("NO_SOCIAL_LINKS", "INFO")),
        (~F.col("has_nav") & (own_links < 3), finding("LIMITED_NAVIGATION", "LOW", confidence="MEDIUM")),
        (F.col("stock_images") >= 3, finding("STOCK_IMAGES", "LOW", provenance="INFERRED", confidence="LOW")),
    ]


FAMILIES = {
    "security": (security_rules, 10_000), "performance": (performance_rules, 20_000), "seo": (seo_rules, 30_000),
    "mobile": (mobile_rules, 40_000), "a11y": (accessibility_rules, 50_000), "tech": (tech_rules, 60_000),
    "content": (content_rules, 70_000),
}


def site_rows(gated: DataFrame, homes: DataFrame, extraction: DataFrame, probes: DataFrame, needs: DataFrame,
              key: str) -> DataFrame:
    """The wide row every rule family reads: gates, home page, extraction, probe counts, category needs."""
    home = PG.tech_stack(homes.withColumns({"placeholder": PG.placeholder(), "js_only": PG.js_only()}))
    home = home.drop("url", "seq", "contact_pages", "business_id" if key != "business_id" else "_none")
    ext = extraction.withColumnsRenamed({"menu_links": "site_menu_links", "has_map": "site_map"}).drop("contact_pages")
    wide = (
        gated.join(home, key, "left").join(ext, key, "left").join(probe_facts(probes, key), key, "left")
        .join(needs, key, "left")
    )
    parked_text = F.coalesce(F.col("placeholder") == "PARKED", F.lit(False))
    dead_app = F.coalesce(
        F.col("js_only") & (F.col("own_scripts") > 0) & (F.col("broken_scripts") == F.col("own_scripts")), F.lit(False)
    )
    return wide.withColumn(
        "gate",
        F.coalesce("gate", F.when(parked_text, "parked_text").when(dead_app, "js_broken")),
    )


def audit_findings(rows: DataFrame, key: str, families: list[str] | None = None) -> DataFrame:
    """Findings of all rule families; content families only on sites that passed every gate.

    One projection over the wide row: all rules share one scan and no shuffle.
    """
    open_site = F.col("gate").isNull()
    late = [
        (F.coalesce(F.col("gate") == "parked_text", F.lit(False)), finding("DOMAIN_PARKED", "CRITICAL", catalog_key="DOMAIN_PARKED_TEXT")),
        (F.coalesce(F.col("gate") == "js_broken", F.lit(False)), finding("JS_APP_BROKEN", "CRITICAL")),
    ]
    rules: list[tuple[Column, Column]] = []
    chosen = families or ["network", *FAMILIES]
    if "network" in chosen:
        rules += network_rules() + late
    for name, (make, _) in FAMILIES.items():
        if name in chosen:
            gate = open_site & ~F.coalesce("js_only", F.lit(False)) if name == "content" else open_site
            rules += [(gate & cond, f) for cond, f in make()]
    return emit(rows, rules, [key])


def site_status(rows: DataFrame, deduped: DataFrame, key: str) -> DataFrame:
    """Final status, reason, technical score and completeness per site."""
    counts = severity_counts(deduped, key).join(technical_score(deduped, key), key)
    df = rows.select(key, "gate", "reason", "outcome", F.coalesce("js_only", F.lit(False)).alias("js_limited")).join(counts, key, "left")
    crit, high, med = (F.coalesce(c, F.lit(0)) for c in ("n_critical", "n_high", "n_medium"))
    gate = F.col("gate")
    status = (
        F.when(gate.isin("third_party", "redirect_third_party"), "SIN_WEB")
        .when(gate.isin("url_invalid", "discontinued", "down", "parking_host", "parked_text", "js_broken"), "WEB_CAIDA")
        .when(gate.isNotNull(), "WEB_NO_VERIFICABLE")
        .when((crit > 0) | (high > 0) | (med >= 3), "WEB_FUNCIONAL_CON_PROBLEMAS")
        .when(F.col("js_limited"), "WEB_NO_VERIFICABLE")
        .otherwise("WEB_ACEPTABLE")
    )
    score = F.when(status == "WEB_CAIDA", 0).when(gate.isNull(), F.coalesce("technical_score", F.lit(100)))
    complete = F.when(gate.isNull(), ~F.col("js_limited")).otherwise(
        gate.isin("third_party", "down", "redirect_third_party", "parking_host", "parked_text", "js_broken")
        # a discontinued builder's site counts as analysed only if its host still answers
        | ((gate == "discontinued") & F.coalesce(F.col("outcome") == "ok", F.lit(False))))
    return df.select(key, "gate", status.alias("website_status"), F.coalesce("reason", F.lit("")).alias("fetch_reason"),
                     score.cast("bigint").alias("technical_score"), complete.alias("analysis_complete"))
