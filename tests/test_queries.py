"""Registered queries against their SQL on the smallest data folder.

A representative set runs by default; VITRINA_ALL=1 runs every key (tools/check.py does the same with timings).
"""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from vitrina.plans.fixtures import BASE_TABLES

DATA = "/root/testdata/sf0.001"
DEFAULT = [
    "findings_dedupe", "score_contributions", "opportunity_score", "recommendations", "business_snapshot", "export_csv_lines",
    "filter_combined", "sort_rating", "dashboard_stats", "followup_agenda", "analysis_history", "contacts_union",
    "src_places_json", "src_places_osm", "hours_text_parse", "business_upsert", "geo_nearest", "round_robin_sample",
    "official_site", "robots_allowed", "emails_in_text", "dated_mentions", "redact_secrets", "classify_url",
    "phone_normalize", "review_findings", "hours_consistency", "consistency_score", "capture_outcome",
    "finding_rules_network", "stream_lead_state", "stream_scan_cost",
    "official_site_verified", "official_site_notes", "link_targets", "crawl_frontier_robots", "analysis_append", "business_card_lists",
    "business_card_full", "stream_hanging_jobs", "stream_followup_alerts", "stream_reanalyze_pending", "batch_reanalyze_pending",
    "stream_scan_completed", "scan_fair_sample", "scan_request_usage", "export_file_lines", "list_positions", "jsonld_nested",
    "opportunity_score_weighted", "top_opportunities", "opportunity_reason",
]
KEYS = sorted(entry.queries()) if os.environ.get("VITRINA_ALL") else DEFAULT


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) else str(int(v))
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert cols and got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_ranked(spark):
    rows = entry.entry(spark).collect()
    scores = [r["opportunity_score"] for r in rows]
    assert rows and scores == sorted(scores, reverse=True)
