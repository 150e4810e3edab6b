"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vitrina.plans import catalog  # noqa: E402
from vitrina.session import builder  # noqa: E402

HEADLINE = [
    "findings_dedupe", "opportunity_score", "recommendations", "top_opportunities", "business_snapshot", "dashboard_stats",
    "filter_combined", "sort_default", "followup_agenda", "analysis_history", "contacts_union", "scan_outcome", "scan_cost",
    "business_upsert", "geo_nearest", "round_robin_sample", "official_site", "hours_consistency", "review_signals",
    "emails_in_text", "text_normalize", "redact_secrets", "classify_url", "robots_allowed", "capture_outcome", "export_rows",
    "page_features", "finding_rules_seo", "stream_lead_state",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench", f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    keys = sys.argv[1:] or HEADLINE
    catalog.QUERIES["filter_level"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in keys:
        started = time.time()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - started, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
