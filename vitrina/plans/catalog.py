"""All registered queries."""

from . import (  # noqa: F401
    audit_queries, consistency_queries, listing_queries, page_queries, sampling_queries, scoring_queries, site_queries, source_queries, store_queries, stream_queries, text_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
