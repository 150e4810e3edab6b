"""Scoring weights and API prices."""

from __future__ import annotations

# --- fixed values: weights, caps and thresholds ----------------------------------------------
TECHNICAL_PENALTY = {"CRITICAL": 30, "HIGH": 15, "MEDIUM": 7, "LOW": 2, "INFO": 0}
WEB_POINTS = {"CRITICAL": 15.0, "HIGH": 7.0, "MEDIUM": 3.0, "LOW": 0.5, "INFO": 0.0}
WEB_MAX = 40
WEB_NONE = 40
WEB_DOWN = 40
WEB_PROBLEMS_CAP = 35
WEB_ACCEPTABLE_CAP = 8
CONSISTENCY_MAX = 20
CONSISTENCY_POINTS = {
    "PHONE_MISMATCH": 8,
    "ADDRESS_MISMATCH": 6,
    "HOURS_MISMATCH": 6,
    "STATUS_CONFLICT": 6,
    "STALE_COVID_NOTICE": 5,
    "OLD_DATED_CONTENT": 4,
    "GOOGLE_LISTING_MISSING_WEBSITE": 4,
    "DEAD_EXTERNAL_DOMAINS": 3,
    "SITEMAP_STALE": 2,
    "PROVIDER_MISSING_PHONE": 2,
    "WEBSITE_HOURS_CONTRADICTORY": 2,
    "OLD_COPYRIGHT": 1,
}
REVIEWS_MAX = 10
REVIEW_STRONG_POINTS = 4
REVIEW_WEAK_POINTS = 2
STRONG_REVIEW_CODES = [
    "REVIEW_WRONG_HOURS", "REVIEW_WRONG_PHONE", "REVIEW_WRONG_ADDRESS", "REVIEW_OUTDATED_INFO", "REVIEW_ONLINE_MENU",
]
PRESENCE_TIERS = [(100, 15), (30, 10), (10, 6), (1, 3)]
CONTACT_PHONE, CONTACT_EMAIL, CONTACT_FORM_OR_CHAT = 6, 2, 2
NEED_BOOKING, NEED_MENU = 5, 5
TEMPORARILY_CLOSED = -15
LEVEL_HIGH, LEVEL_MEDIUM, MIN_CONFIDENCE, RELIABLE_PROVIDER = 60, 40, 40, 0.7

SKU_PRICE_PER_1000 = {
    "google_text_search_pro": 32.0,
    "google_text_search_enterprise": 35.0,
    "google_text_search_enterprise_atmosphere": 40.0,
    "google_place_details_enterprise": 20.0,
    "google_place_details_enterprise_atmosphere": 25.0,
    "search_brave": 5.0,
}
# --- end of fixed values ---------------------------------------------------------------------
