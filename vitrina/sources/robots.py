"""robots.txt and sitemap texts as rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.regex import BLANKS

DEFAULT_AGENT = "sitecheck"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def parse_robots(files: DataFrame, agent: str = DEFAULT_AGENT, key: str = "site_id") -> DataFrame:
    """(site, kind, seq, value) rows that apply to ``agent``; kind is allow, disallow or sitemap.

    A run of agent lines opens a group; groups naming the agent replace the ``*`` groups. A robots file is a
    few kilobytes by protocol, so the per-file windows are small.
    """
    lines = files.select(
        key, F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")
    ).withColumn("line", _trim(F.regexp_replace("line", "#.*$", "")))
    pairs = lines.where(F.contains("line", F.lit(":"))).select(
        key, "line_no",
        F.lower(_trim(F.regexp_extract("line", "^([^:]*):(.*)$", 1))).alias("name"),
        _trim(F.regexp_extract("line", "^([^:]*):(.*)$", 2)).alias("value"),
    )
    w = Window.partitionBy(key).orderBy("line_no")
    is_agent = F.col("name") == "user-agent"
    opens = is_agent & F.coalesce(F.lag("name").over(w) != "user-agent", F.lit(True))
    grouped = pairs.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn(
        "grp", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    value = F.lower("value")
    per_group = Window.partitionBy(key, "grp")
    named = is_agent & (value != "*") & F.contains(F.lit(agent.lower()), value)
    marked = grouped.withColumns({
        "specific": F.coalesce(F.max(F.when(named, 1)).over(per_group), F.lit(0)),
        "general": F.coalesce(F.max(F.when(is_agent & (value == "*"), 1)).over(per_group), F.lit(0)),
    }).withColumn("any_specific", F.max("specific").over(Window.partitionBy(key)))
    chosen = F.when(F.col("any_specific") == 1, F.col("specific") == 1).otherwise(F.col("general") == 1)
    rule = F.col("name").isin("allow", "disallow") & (F.col("grp") > 0) & chosen
    return marked.where((F.col("value") != "") & ((F.col("name") == "sitemap") | rule)).select(
        key, F.col("name").alias("kind"), F.col("line_no").cast("bigint").alias("seq"), "value"
    )


def path_pattern(rule: Column) -> Column:
    """robots path pattern as a regular expression: ``*`` is anything, a final ``$`` anchors the end."""
    anchored = rule.endswith("$")
    body = F.when(anchored, F.regexp_replace(rule, r"\$$", "")).otherwise(rule)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(
        F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit(""))
    )


def allowed(paths: DataFrame, rules: DataFrame, key: str = "site_id") -> DataFrame:
    """Add ``allowed`` to (site, path) rows: longest matching rule wins, allow wins ties, no match allows.

    Rules are folded into one small array per site first, so checking costs no row blow-up.
    """
    per_site = rules.where(F.col("kind") != "sitemap").groupBy(key).agg(
        F.collect_list(F.struct(
            F.length("value").alias("len"), (F.col("kind") == "allow").alias("allow"),
            path_pattern(F.col("value")).alias("re"),
        )).alias("rules")
    )
    joined = paths.join(per_site, key, "left")
    best = F.array_max(F.transform(
        F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["re"])),
        lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow")),
    ))
    state = F.col("robots_status") if "robots_status" in paths.columns else F.lit("parsed")
    return joined.withColumn(
        "allowed",
        F.when(state == "unavailable", False)
        .when(F.col("path") == "/robots.txt", True)
        .otherwise(F.coalesce(best["allow"], F.lit(True))),
    ).drop("rules")


def sitemap_lastmod(sitemaps: DataFrame, as_of: Column, key: str = "site_id") -> DataFrame:
    """Newest plausible ``<lastmod>`` of the first readable sitemap per site.

    Input (site, seq, status, xml) with ``seq`` the candidate order. Each file is reduced to its newest date before
    anything is shuffled.
    """
    readable = sitemaps.where((F.col("status") == 200) & F.col("xml").rlike("(?i)<(urlset|sitemapindex)"))
    stamps = F.regexp_extract_all("xml", F.lit(rf"(?i)<lastmod>[{BLANKS}]*([^<{BLANKS}]+)[{BLANKS}]*</lastmod>"), F.lit(1))
    dates = F.transform(stamps, lambda s: F.try_to_timestamp(s))
    newest = F.array_max(F.filter(dates, lambda d: d.isNotNull() & (d < as_of + F.expr("interval 1 day"))))
    return (
        readable.select(key, "seq", newest.alias("newest"))
        .groupBy(key).agg(F.min_by("newest", "seq").alias("lastmod"))
        .where("lastmod is not null")
    )
