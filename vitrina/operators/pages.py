"""Page features, crawl candidates and page-level predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as HT
from ..functions import text as T
from ..functions import url as U
from ..rules import patterns as P
from ..rules.regex import java
from .links import keep_allowed


# what the visible text, the headings and the telephone links of a page are made from
TEXT_FACTS = {"_raw", "_page", "_clean", "_host", "_bare", "_tags", "_base", "_anchors", "text", "title", "h1", "tel_links"}


def features(pages: DataFrame, html: str = "html", url: str = "url", only: set[str] | None = None) -> DataFrame:
    """All page facts (or those named) beside the input keys; the raw HTML is not carried on."""
    df = pages
    for layer in HT.page_columns(F.col(html), F.col(url)):
        df = df.withColumns({name: c for name, c in layer.items() if only is None or name in only})
    return df.drop(html, *[c for c in df.columns if c.startswith("_")])


def js_only(wordy: str = "word_count") -> Column:
    """Page that shows almost nothing without running its scripts."""
    return (
        (F.col(wordy) < 60)
        & ((F.size("scripts") > 0) | (F.col("inline_scripts") > 0))
        & (F.col("app_shell") | F.col("noscript_js") | (F.size("scripts") >= 3))
    )


def placeholder() -> Column:
    return T.placeholder_kind(F.concat(F.col("text"), F.lit(" "), F.coalesce("title", F.lit(""))))


def tech_stack(df: DataFrame) -> DataFrame:
    """CMS name and jQuery version."""
    gen = F.coalesce("generator", F.lit(""))
    wp = F.regexp_extract(gen, java(r"wordpress\s*([\d.]+)?"), 1)
    versions = F.filter(F.transform(
        F.filter("scripts", lambda s: s.rlike(java(P.JQUERY))),
        lambda s: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(s, java(P.JQUERY), 1), F.lit("")),
                       F.nullif(F.regexp_extract(s, java(P.JQUERY), 5), F.lit(""))).alias("v"),
            s.alias("src"),
        ),
    ), lambda v: F.lit(True))
    cms = (
        F.when(gen.rlike("(?i)wordpress"), F.when(wp != "", F.concat(F.lit("WordPress "), wp)).otherwise("WordPress"))
        .when(gen.rlike("(?i)joomla"), gen)
        .when(gen.rlike(r"(?i)wix\.com"), "Wix")
        .when(gen.rlike("(?i)drupal"), gen)
        .when(F.exists("scripts", lambda s: s.rlike("wp-content|wp-includes")), "WordPress")
    )
    return df.withColumns({
        "cms": cms, "wordpress_version": F.nullif(wp, F.lit("")), "jquery": F.get(versions, F.lit(0))["v"],
        "jquery_src": F.get(versions, F.lit(0))["src"],
    })


def page_links(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per link of a page, in order."""
    return pages.select(*keys, F.posexplode("links").alias("k", "l")).select(
        *keys, "k", "l.href", "l.text", "l.internal", F.col("l.parts.host").alias("host"),
        F.concat(F.col("l.parts.path"), F.col("l.parts.query")).alias("path"),
    )


def frontier(homes: DataFrame, rules: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """Further pages to fetch per home page: contact links first, then keyword kinds, each address once.

    ``rules`` are robots rules (business_id, kind, value); addresses they forbid take no place. Candidates live in one home
    page's link array, so the choice is a projection. ``max_pages`` counts the home page; None sets no limit.
    """
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/$", "")

    def kind_of(x: Column) -> Column:
        hay = F.concat(x["text"], F.lit(" "), x["parts"]["path"])
        return F.coalesce(*[F.when(hay.rlike(java(p)), F.lit(k)) for k, p in P.FRONTIER_KINDS])

    contact = F.filter("links", lambda x: F.array_contains("contact_pages", x["href"]))
    entry = lambda x, k: F.struct(bare(x["href"]).alias("url"), k.alias("kind"), x["parts"]["path"].alias("path"),
                                  F.concat(x["parts"]["path"], F.coalesce(x["parts"]["query"], F.lit(""))).alias("asked"))
    wanted = F.concat(
        F.transform(contact, lambda x: entry(x, F.lit("contact"))),
        F.filter(
            F.transform(F.filter("links", lambda x: x["internal"]), lambda x: entry(x, kind_of(x))),
            lambda e: e["kind"].isNotNull(),
        ),
    )
    usable = F.filter(
        wanted, lambda e: ~e["path"].rlike(java(P.BINARY_PATH)) & (e["url"] != F.regexp_replace("url", "/$", "")))
    once = HT._first_by(usable, "url")
    rows = homes.select("business_id", F.posexplode(once).alias("k", "e")).select(
        "business_id", "k", F.col("e.asked").alias("path"), F.col("e.url").alias("page_url"), F.col("e.kind").alias("kind"))
    ranked = keep_allowed(rows, rules).select("business_id", "page_url", "kind", "k").withColumn(
        "position", F.row_number().over(Window.partitionBy("business_id").orderBy("k")))
    return ranked if max_pages is None else ranked.where(F.col("position") <= max_pages - 1)


def social_links(links: DataFrame, *keys: str) -> DataFrame:
    """Profile and chat links among page links."""
    parts = U.parse(F.regexp_replace("href", "#.*$", ""))
    kind = F.coalesce(U.social_profile(F.col("u")), F.when(U.is_chat_link(F.col("u")), "WHATSAPP"))
    return (
        links.withColumn("u", parts).withColumn("type", kind).where("type is not null")
        .select(*keys, "type", F.when(F.col("type") == "WHATSAPP", F.col("href")).otherwise(
            U.canonical_social(F.col("u"))).alias("profile"))
    )
