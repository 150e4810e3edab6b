"""What a site check fetches next: addresses that robots rules allow, link targets with quotas by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..sources.robots import path_pattern

KEY = "business_id"
# --- fixed values: how many targets of a kind one check visits -------------------------------
QUOTAS = {"link": 25, "image": 15, "resource": 15, "domain": 10}
# --- end of fixed values ---------------------------------------------------------------------


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def allowed_paths(paths: DataFrame, rules: DataFrame, key: str = KEY) -> DataFrame:
    """(key, path, allowed) of the distinct paths: the longest matching rule decides, allow wins ties, no match allows.

    A rule is filed under its literal beginning, the part before the first wildcard or end mark. A path is spread over those of
    its own beginnings whose length some rule of its site has, and meets rules by an equi-join on (site, beginning): the
    levels of a prefix tree as rows. Only rules with wildcards run a pattern, and only on paths that share their beginning.
    A site's many paths or rules are many join keys, so no group is gathered.
    """
    marks = r"[*]|[$]$"
    filed = rules.where(F.col("kind").isin("allow", "disallow")).select(
        key, F.regexp_extract("value", rf"^(.*?)(?:{marks}|$)", 1).alias("head"), F.length("value").alias("len"),
        (F.col("kind") == "allow").alias("allow"), F.when(F.col("value").rlike(marks), path_pattern(F.col("value"))).alias("pattern"),
    ).distinct()
    lengths = filed.groupBy(key).agg(F.collect_set(F.length("head")).alias("lengths"))  # numbers up to the longest address
    asked = paths.select(key, "path").distinct()
    spread = asked.join(lengths, key).withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).select(
        key, "path", F.substring("path", F.lit(1), F.col("n")).alias("head"))
    met = spread.join(filed, [key, "head"]).where(F.col("pattern").isNull() | F.regexp_like("path", "pattern"))
    best = met.groupBy(key, "path").agg(F.max(F.struct("len", "allow")).alias("best"))
    return asked.join(best, [key, "path"], "left").select(
        key, "path", ((F.col("path") == "/robots.txt") | F.coalesce(F.col("best.allow"), F.lit(True))).alias("allowed"))


def keep_allowed(rows: DataFrame, rules: DataFrame | None, key: str = KEY) -> DataFrame:
    """Rows (key, path, ...) whose path may be fetched."""
    if rules is None:
        return rows
    banned = allowed_paths(rows, rules, key).where(~F.col("allowed"))
    return rows.join(banned.select(key, "path"), [key, "path"], "left_anti")


def link_targets(pages: DataFrame, fetched: DataFrame, rules: DataFrame | None = None, quotas: dict[str, int] | None = None,
                 home: str = "home_host") -> DataFrame:
    """(business_id, target_kind, position, target_url) still to be probed after a site's pages were read.

    ``pages`` are page features (business_id, seq, links, images, scripts, stylesheets) with the site's own host in ``home``;
    ``fetched`` (business_id, url) are pages read already, which are not probed as links. Each target counts once, where it
    first appears; links come without fragment and need the robots rules' leave; outside hosts are kept when they are no
    known platform and another domain. ``quotas`` cuts kinds to their first few (``QUOTAS`` is the usual set); without it
    every target is returned.
    """
    inside = F.transform(F.filter("links", lambda x: x["internal"]), lambda x: F.struct(
        F.lit("link").alias("kind"), F.regexp_replace(x["href"], "#.*$", "").alias("url"),
        F.concat(x["parts"]["path"], F.coalesce(x["parts"]["query"], F.lit(""))).alias("path")))
    plain = lambda urls, kind: F.transform(
        F.filter(urls, lambda u: u.rlike("(?i)^https?:")), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("url"), F.lit(None).cast("string").alias("path")))
    outside = F.transform(F.filter("links", lambda x: ~x["internal"] & x["parts"]["host"].isNotNull()), lambda x: F.struct(
        F.lit("host").alias("kind"), x["parts"]["host"].alias("url"), x["parts"]["path"].alias("path")))
    urls = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    found = [inside, plain(urls(F.transform("images", lambda i: i["src"])), "image"),
             plain(F.concat(urls(F.col("scripts")), urls(F.col("stylesheets"))), "resource"), outside]
    none = F.array().cast("array<struct<kind:string,url:string,path:string>>")
    listed = F.concat(*[F.coalesce(part, none) for part in found])
    rows = pages.select(KEY, "seq", F.col(home).alias("home"), F.posexplode(listed).alias("k", "t")).select(KEY, "seq", "home", "k", "t.*")
    other_site = U.registrable_domain(F.col("url")) != U.registrable_domain(F.col("home"))
    known = U.platform(F.col("url"), F.col("path"))["kind"].isNotNull()
    seen_at = F.min(F.struct("seq", "k")).alias("first")
    once = rows.where("kind <> 'host'").groupBy(KEY, "kind", "url", "path").agg(seen_at)
    hosts = rows.where("kind = 'host'").groupBy(KEY, "home", "url", "path").agg(seen_at).where(~known & other_site).groupBy(KEY, "url").agg(
        F.min("first").alias("first")).select(KEY, F.lit("domain").alias("kind"), "url", F.lit(None).cast("string").alias("path"), "first")
    read = fetched.select(KEY, F.lit("link").alias("kind"), without_slash(F.col("url")).alias("bare")).distinct()
    links = once.where("kind = 'link'").withColumn("bare", without_slash(F.col("url"))).join(read, [KEY, "kind", "bare"], "left_anti").drop("bare")
    wanted = keep_allowed(links, rules).unionByName(once.where("kind <> 'link'")).unionByName(hosts)
    ranked = wanted.withColumn("position", F.row_number().over(Window.partitionBy(KEY, "kind").orderBy("first", "url")))
    if quotas is not None:
        most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
        ranked = ranked.where(F.col("position") <= max(quotas.values())).where(F.col("position") <= most)
    return ranked.select(KEY, F.col("kind").alias("target_kind"), "position", F.col("url").alias("target_url"))
