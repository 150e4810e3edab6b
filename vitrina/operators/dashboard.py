"""Dashboard counters, agenda, scan and job health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.vocab import WEBSITE_STATUSES
from .listing import open_lead


def counters(business: DataFrame, scans: DataFrame) -> DataFrame:
    """All dashboard figures: one pass over businesses, one over scans."""
    analysed = F.col("last_analyzed_at").isNotNull()
    by_status = lambda s: F.count_if(analysed & (F.col("website_status") == s))
    stats = business.agg(
        F.count_if(analysed).alias("analyzed"),
        by_status("SIN_WEB").alias("no_website"),
        by_status("WEB_CAIDA").alias("down"),
        by_status("WEB_FUNCIONAL_CON_PROBLEMAS").alias("problems"),
        F.count_if(F.col("consistency_issue_count") > 0).alias("info_problems"),
        F.count_if(F.col("has_phone") | F.col("has_email")).alias("with_contact"),
        F.count_if(F.col("opportunity_level") == "HIGH").alias("high"),
    )
    cost = scans.agg(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)).alias("total_cost"))
    # both sides are exactly one row
    return stats.withColumn("k", F.lit(1)).join(cost.withColumn("k", F.lit(1)), "k").drop("k")


def status_counts(business: DataFrame, *keys: str) -> DataFrame:
    return business.where(F.col("last_analyzed_at").isNotNull()).groupBy(*keys, "website_status").agg(
        F.count("*").alias("n")
    )


def status_by_scan(scan_business: DataFrame, business: DataFrame) -> DataFrame:
    """Businesses per scan and website status, one column per status."""
    rows = scan_business.join(business.select("business_id", "website_status"), "business_id")
    return rows.groupBy("scan_id").agg(
        *[F.count_if(F.col("website_status") == s).alias(s.lower()) for s in WEBSITE_STATUSES],
        F.count_if(F.col("website_status").isNull()).alias("pending"),
    )


def top_opportunities(business: DataFrame, limit: int = 8) -> DataFrame:
    return business.where(F.col("opportunity_score").isNotNull() & open_lead()).orderBy(
        F.col("opportunity_score").desc(), F.col("user_rating_count").desc_nulls_last(), F.col("business_id")
    ).limit(limit)


def due_soon(business: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    soon = as_of + F.expr("interval 24 hours")
    return business.where((F.col("next_follow_up_at") <= soon) & open_lead()).orderBy(
        "next_follow_up_at", "business_id"
    ).limit(limit)


def recent_scans(scans: DataFrame, limit: int = 5) -> DataFrame:
    return scans.orderBy(F.col("created_at").desc(), F.col("scan_id").desc()).limit(limit)


def cities(business: DataFrame, limit: int | None = None) -> DataFrame:
    found = business.where("city is not null").select("city").distinct().orderBy("city")
    return found if limit is None else found.limit(limit)


def agenda(business: DataFrame, as_of: Column, limits: dict[str, int] | None = None) -> DataFrame:
    """Follow-up buckets, whole; a bucket named in ``limits`` is its own top-k, so it is not sorted in one task."""
    tomorrow = F.date_trunc("day", as_of) + F.expr("interval 1 day")
    at = F.col("next_follow_up_at")
    live = business.where(open_lead())
    buckets = {
        "overdue": live.where(at < as_of),
        "today": live.where((at >= as_of) & (at < tomorrow)),
        "upcoming": live.where(at >= tomorrow),
        "to_contact": business.where((F.col("lead_status") == "TO_CONTACT") & at.isNull()),
    }
    order = {"to_contact": [F.col("opportunity_score").desc_nulls_last(), F.col("business_id")]}
    out = None
    for name, df in buckets.items():
        limit = (limits or {}).get(name)
        part = (df if limit is None else df.orderBy(*order.get(name, [at, F.col("business_id")])).limit(limit)).withColumn("bucket", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def scan_outcome(scans: DataFrame, scan_business: DataFrame, business: DataFrame) -> DataFrame:
    """State each scan moves to once its counters are known, with its high-opportunity count."""
    high = (
        scan_business.join(
            business.where(F.col("opportunity_level") == "HIGH").select("business_id"), "business_id", "left_semi"
        ).groupBy("scan_id").agg(F.count("*").alias("high"))
    )
    processed = F.col("total_analyzed") + F.col("total_failed")
    finished = (F.col("status") == "ANALYZING") & (processed >= F.col("total_found"))
    return scans.join(high, "scan_id", "left").select(
        "scan_id",
        F.when(finished, F.when(F.col("total_failed") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))
        .otherwise(F.col("status")).alias("status"),
        processed.alias("processed"),
        F.when(finished, F.coalesce("high", F.lit(0))).alias("high"),
    )


def job_counts(jobs: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """Queued, running and failed jobs, and failures of the last day."""
    is_ = lambda s: F.col("status") == s
    return jobs.groupBy(*keys).agg(
        F.count_if(is_("QUEUED")).alias("queued"),
        F.count_if(is_("RUNNING")).alias("running"),
        F.count_if(is_("FAILED")).alias("failed"),
        F.count_if(is_("FAILED") & (F.col("finished_at") >= as_of - F.expr("interval 1 day"))).alias("failed_24h"),
    )


def live_workers(beats: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    return beats.groupBy("worker_id").agg(F.max("beat_at").alias("last_beat_at")).where(
        F.col("last_beat_at") >= as_of - F.expr(f"interval {seconds} seconds")
    )


def history(analyses: DataFrame, limit: int = 20) -> DataFrame:
    """Newest analyses per business.

    Spark turns ``row_number() <= limit`` into a group limit ahead of the shuffle, so a business with a very long
    history sends at most ``limit`` rows per map task.
    """
    newest = [F.col("created_at").desc(), F.col("analysis_id").desc()]
    ranked = analyses.withColumn("position", F.row_number().over(Window.partitionBy("business_id").orderBy(*newest)))
    return ranked.where(F.col("position") <= limit)


def latest(analyses: DataFrame) -> DataFrame:
    """Latest analysis per business; a partial aggregate, safe for any history length."""
    cols = [c for c in analyses.columns if c != "business_id"]
    return analyses.groupBy("business_id").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "analysis_id")).alias("a")
    ).select("business_id", "a.*")
