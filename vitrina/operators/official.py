"""Official site of businesses whose listing names none: ranked search hits verified on the fetched home pages.

A hit is in play when it is the first of its registrable domain, no directory or marketplace, and among the first few such
hits of its business; the walk over a business's hits ends at the first verified one. Only home pages of hits in play are
taken from the table of captures, and a page's facts are worked out once per home page and country, however many businesses
it was found for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phone as PH
from ..functions import text as T
from ..functions import url as U
from ..functions.literals import literal_map
from ..rules.vocab import PROVIDER_LABEL
from ..sources.captures import is_html
from .discovery import _ignored
from .findings import emit, finding
from .pages import TEXT_FACTS, features

KEY = "business_id"
MAX_CANDIDATES = 3
MIN_COVERAGE = 0.6
NOTE = "Posibles webs encontradas en buscador pero NO verificadas: "


def in_play(hits: DataFrame, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """(business_id, position, home) of the hits worth fetching, from (business_id, rnk, url).

    Repeats of a domain go in a partial aggregate before any platform lookup; the cut at ``max_candidates`` is a group limit.
    """
    parsed = hits.select(KEY, "rnk", "url", U.parse(F.col("url")).alias("u")).where("u is not null")
    first = parsed.groupBy(KEY, U.registrable_domain(F.col("u.host")).alias("domain")).agg(
        F.min_by("u", F.struct("rnk", "url")).alias("u"), F.min(F.struct("rnk", "url")).alias("at"))
    kind = U.platform(F.col("u.host"), F.col("u.path"))["kind"]
    usable = first.where(~_ignored(F.col("u.host"), F.col("domain")) & F.coalesce(kind == "FREE_SUBDOMAIN_BUILDER", F.lit(True)))
    home = F.concat(F.col("u.scheme"), F.lit("://"), F.col("u.host"), F.col("u.port"), F.lit("/"))
    ranked = usable.select(KEY, home.alias("home"), F.row_number().over(Window.partitionBy(KEY).orderBy("at")).alias("position"))
    return ranked.where(F.col("position") <= max_candidates)


def home_facts(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts of the last attempt at each wanted (home, country): outcome, final address, phones, searchable text.

    ``captures`` has (requested_url, attempt, url, status, content_type, error_code, html).
    """
    outcome = ["attempt", "url", "status", "content_type", "error_code", "html"]
    last = (
        captures.join(wanted.select(F.col("home").alias("requested_url")).distinct(), "requested_url", "left_semi")
        .groupBy("requested_url").agg(F.max_by(F.struct(*outcome), F.struct("attempt", "url")).alias("c"))
        .select(F.col("requested_url").alias("home"), "c.*")
    )
    refused = F.coalesce(F.col("status") >= 400, F.col("status").isNull())
    reason = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(
        refused | ~is_html(F.col("content_type")), F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("?"))))
    judged = last.withColumn("unread", reason).withColumn("html", F.when(F.col("unread").isNull(), F.col("html")))
    read = features(judged.select("home", "url", "unread", "html", F.col("url").alias("final_url")), only=TEXT_FACTS).select(
        "home", "final_url", "unread", "tel_links", "text",
        F.concat_ws(" ", "title", F.array_join("h1", " "), "text").alias("hay")).withColumn("plain", T.normalize_text(F.col("hay")))
    told = F.transform("tel_links", lambda x: PH.e164(x, F.col("country_code")))
    return read.join(wanted.distinct(), "home").select(
        "home", "country_code", "final_url", "unread", "hay", "plain",
        F.array_compact(F.array_union(told, PH.phones_in_text(F.col("text"), F.col("country_code"), None))).alias("phones"))


def _verdict() -> Column:
    """struct<verification, reason why not> of a business beside the facts of one home page."""
    own = PH.e164(F.coalesce("international_phone", "national_phone"), F.col("country_code"))
    by_phone = F.coalesce(F.array_contains("phones", own), F.lit(False))
    cover = T.let(T.name_tokens(F.col("name")), lambda tokens: T.covered(tokens, F.col("plain")))
    named = lambda c, use: F.coalesce((c != "") & use, F.lit(False))
    located = named(F.col("city"), F.contains("plain", T.normalize_text(F.col("city")))) | named(
        F.col("postal_code"), F.contains("hay", "postal_code"))
    facts = F.struct(by_phone.alias("phone"), cover.alias("cover"), located.alias("located"))
    read = F.col("unread").isNull() & F.col("hay").isNotNull()
    failed = F.concat(F.lit("No verificable ("), F.coalesce("unread", F.lit("error")), F.lit(")"))

    def judge(f: Column) -> Column:
        weak = F.concat(F.lit("Coincidencia insuficiente (nombre "), F.floor(f["cover"] * 100 + 0.5).cast("string"),
                        F.lit("%, ubicación "), F.when(f["located"], "sí").otherwise("no"), F.lit(")"))
        how = F.when(f["phone"], "phone").when((f["cover"] >= MIN_COVERAGE) & f["located"], "name_location")
        return F.struct(F.when(read, how).alias("verification"), F.when(read, weak).otherwise(failed).alias("reason"))

    return T.let(F.when(read, facts), judge)


def find(business: DataFrame, hits: DataFrame, captures: DataFrame, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """One row per business: the verified ``url`` with its ``verification``, or the ``candidates`` (url, reason) looked at.

    ``business`` holds those to search for: business_id, name, city, postal_code, country_code, national_phone,
    international_phone. A hit whose home page was never fetched counts as one that cannot be verified.
    """
    who = business.select(KEY, "name", "city", "postal_code", "country_code", "national_phone", "international_phone")
    pairs = in_play(hits.join(who.select(KEY), KEY, "left_semi"), max_candidates).join(who, KEY)
    facts = home_facts(captures, pairs.select("home", "country_code"))
    seen = pairs.join(facts.withColumnRenamed("country_code", "_country"),
                      (pairs["home"] == facts["home"]) & pairs["country_code"].eqNullSafe(F.col("_country")), "left").drop(facts["home"])
    told = seen.select(KEY, "position", _verdict().alias("v"), F.coalesce(
        F.when(F.col("unread").isNull(), F.col("final_url")), F.col("home")).alias("url")).select(KEY, "position", "url", "v.*")
    hit = F.col("verification").isNotNull()
    before = Window.partitionBy(KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    walked = told.withColumn("done", F.coalesce(F.max(hit).over(before), F.lit(False))).where(~F.col("done"))
    result = walked.groupBy(KEY).agg(
        F.max(F.when(hit, F.col("url"))).alias("url"), F.max("verification").alias("verification"),
        F.sort_array(F.collect_list(F.when(~hit, F.struct("position", "url", "reason")))).alias("candidates"))
    shown = F.transform(F.coalesce("candidates", F.array()), lambda c: F.struct(c["url"].alias("url"), c["reason"].alias("reason")))
    return who.select(KEY).join(result, KEY, "left").select(KEY, "url", "verification", shown.alias("candidates"), F.lit(True).alias("search_checked"))


def found_findings(found: DataFrame, business: DataFrame, previous: DataFrame, base_seq: int = 400_000) -> DataFrame:
    """Findings of a verified search result: those of the listed address as mere information, and the missing link itself."""
    hit = found.where("url is not null")
    softened = previous.join(hit.select(KEY), KEY, "left_semi").withColumn("severity", F.lit("INFO"))
    provider = F.coalesce(literal_map(PROVIDER_LABEL)[F.col("provider_key")], F.lit("OpenStreetMap"))
    how = F.when(F.col("verification") == "phone", "coincidencia de teléfono").otherwise("coincidencia de nombre y ubicación")
    rule = finding(
        "GOOGLE_LISTING_MISSING_WEBSITE", "MEDIUM", value=provider, evidence=F.col("url"),
        description=F.concat(F.lit("La web se ha encontrado mediante buscador y se ha verificado por "), how, F.lit(".")),
        confidence=F.when(F.col("verification") == "phone", "HIGH").otherwise("MEDIUM"))
    missing = emit(hit.join(business.select(KEY, "provider_key"), KEY), [(F.lit(True), rule)], [KEY], base_seq)
    return softened.unionByName(missing, allowMissingColumns=True)


def search_notes(found: DataFrame) -> DataFrame:
    """(business_id, note): candidates that were found but not verified."""
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["url"], F.lit(" ("), c["reason"], F.lit(")"))), "; ")
    return found.where(F.col("url").isNull() & (F.size("candidates") > 0)).select(KEY, F.concat(F.lit(NOTE), shown).alias("note"))


def to_fetch(found: DataFrame) -> DataFrame:
    """(business_id, requested_url): verified sites for the crawler's next round."""
    return found.where("url is not null").select(KEY, F.col("url").alias("requested_url"))
