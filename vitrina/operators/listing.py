"""Filtered, sorted and paged business lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.vocab import CLOSED_LEADS, LEAD_STATUSES, LEVELS, WEBSITE_STATUSES

SORTS = ["opportunity", "name", "rating", "reviews", "analyzed", "websiteScore", "followUp"]
_TEXT_LIMITS = {"q": 100, "scan_id": 40, "category": 60, "city": 80}
_ENUMS = {
    "website_status": WEBSITE_STATUSES, "level": LEVELS, "lead_status": LEAD_STATUSES, "sort": SORTS,
    "dir": ["asc", "desc"],
}
_NUMBERS = ["min_rating", "max_rating", "min_reviews"]
_FLAGS = ["has_phone", "has_email", "has_website", "technical_issues", "info_issues", "follow_up_due"]


@dataclass(frozen=True)
class Filters:
    q: str | None = None
    scan_id: str | None = None
    category: str | None = None
    city: str | None = None
    website_status: str | None = None
    level: str | None = None
    lead_status: str | None = None
    min_rating: float | None = None
    max_rating: float | None = None
    min_reviews: float | None = None
    has_phone: bool | None = None
    has_email: bool | None = None
    has_website: bool | None = None
    technical_issues: bool | None = None
    info_issues: bool | None = None
    analyzed_from: str | None = None
    analyzed_to: str | None = None
    follow_up_due: bool | None = None
    sort: str | None = None
    dir: str | None = None
    page: int | None = None
    page_size: int | None = None


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def parse_filters(params: Mapping[str, object]) -> Filters:
    """Lenient reading of request parameters.

    Blanks go; a bad enum, number or page goes alone; an over-long text or a bad flag drops everything.
    """
    known = {f.name for f in fields(Filters)}
    out: dict[str, object] = {}
    for raw_name, raw in params.items():
        name = _snake(raw_name)
        if name not in known or not isinstance(raw, str) or raw == "":
            continue
        if name in _TEXT_LIMITS:
            text = raw.strip() if name == "q" else raw
            if len(text) > _TEXT_LIMITS[name]:
                return Filters()
            out[name] = text
        elif name in _ENUMS:
            if raw in _ENUMS[name]:
                out[name] = raw
        elif name in _NUMBERS:
            try:
                number = float(raw.strip() or 0)
            except ValueError:
                continue
            if number == number:
                out[name] = number
        elif name in _FLAGS:
            if raw not in ("true", "false", "1", "0"):
                return Filters()
            out[name] = raw in ("true", "1")
        elif name in ("page", "page_size"):
            lo, hi = (1, 10_000) if name == "page" else (5, 200)
            try:
                number = float(raw)
            except ValueError:
                continue
            if number == int(number) and lo <= number <= hi:
                out[name] = int(number)
        else:
            out[name] = raw
    return Filters(**out)


def _instant(text: str | None) -> dt.datetime | None:
    if not text:
        return None
    try:
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def _ts(at: dt.datetime) -> Column:
    return F.lit(at.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def open_lead() -> Column:
    return ~F.col("lead_status").isin(CLOSED_LEADS)


def predicates(f: Filters, as_of: Column) -> list[Column]:
    """One Column per set filter; scan membership is a join and stays out of this list."""
    c, out = F.col, []
    if f.q:
        needle = F.lower(F.lit(f.q))
        out.append(F.contains(F.lower("name"), needle) | F.contains(F.lower("formatted_address"), needle))
    if f.category:
        out.append(c("category_key") == f.category)
    if f.city:
        out.append(F.lower("city") == F.lower(F.lit(f.city)))
    for name, column in [("website_status", "website_status"), ("level", "opportunity_level"),
                         ("lead_status", "lead_status")]:
        if getattr(f, name):
            out.append(c(column) == getattr(f, name))
    if f.min_rating is not None:
        out.append(c("rating") >= f.min_rating)
    if f.max_rating is not None:
        out.append(c("rating") <= f.max_rating)
    if f.min_reviews is not None:
        out.append(c("user_rating_count") >= f.min_reviews)
    if f.has_phone is not None:
        out.append(c("has_phone") == f.has_phone)
    if f.has_email is not None:
        out.append(c("has_email") == f.has_email)
    if f.has_website is not None:
        wanted = [s for s in WEBSITE_STATUSES if (s != "SIN_WEB") == f.has_website]
        out.append(c("website_status").isin(wanted))
    for name, column in [("technical_issues", "technical_issue_count"), ("info_issues", "consistency_issue_count")]:
        flag = getattr(f, name)
        if flag is not None:
            out.append(c(column) > 0 if flag else c(column) == 0)
    start, end = _instant(f.analyzed_from), _instant(f.analyzed_to)
    if start:
        out.append(c("last_analyzed_at") >= _ts(start))
    if end:
        out.append(c("last_analyzed_at") <= _ts(end + dt.timedelta(milliseconds=86_399_999)))
    if f.follow_up_due:
        out.append((c("next_follow_up_at") <= as_of) & open_lead())
    return out


def apply_filters(business: DataFrame, f: Filters, as_of: Column, scan_business: DataFrame | None = None) -> DataFrame:
    conditions = predicates(f, as_of)
    df = business.where(reduce(lambda a, b: a & b, conditions)) if conditions else business
    if f.scan_id and scan_business is not None:
        df = in_scan(df, scan_business.where(F.col("scan_id") == F.lit(f.scan_id).cast("bigint")))
    return df


def in_scan(business: DataFrame, scan_business: DataFrame) -> DataFrame:
    return business.join(scan_business, "business_id", "left_semi")


def order_by(f: Filters) -> list[Column]:
    """Sort columns; nulls always last; ``business_id`` settles ties."""
    up = (f.dir or ("asc" if f.sort in ("name", "followUp") else "desc")) == "asc"

    def by(name: str, ascending: bool) -> Column:
        return F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()

    keys = {
        "name": [by("name", up)],
        "rating": [by("rating", up), by("name", True)],
        "reviews": [by("user_rating_count", up), by("name", True)],
        "analyzed": [by("last_analyzed_at", up)],
        "websiteScore": [by("website_score", up)],
        "followUp": [by("next_follow_up_at", up)],
    }.get(f.sort or "", [by("opportunity_score", up), by("user_rating_count", False)])
    return [*keys, F.col("business_id").asc()]


def page(df: DataFrame, f: Filters) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total). Offset and limit become a bounded top-k, not a full sort."""
    size = f.page_size or 50
    start = ((f.page or 1) - 1) * size
    return df.orderBy(*order_by(f)).offset(start).limit(size), df.agg(F.count("*").alias("total"))
