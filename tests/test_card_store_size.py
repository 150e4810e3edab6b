"""What card lists carry through shuffles; how many tasks write one bucket of replaced rows."""

from __future__ import annotations

from pathlib import Path

from vitrina.operators import card
from vitrina.operators.persist import Store
from vitrina.plans import store_queries


def test_card_lists_carry_only_what_a_card_shows(spark, monkeypatch):
    seen = []
    found = spark.createDataFrame([(1, "NO_HTTPS", 1, "t", "d", "HIGH", 1, "SECURITY")],
                                  "business_id long, code string, seq long, title string, description string, severity string, sev_rank int, category string")
    monkeypatch.setattr(store_queries.FI, "dedupe", lambda rows: seen.append(rows.columns) or rows)
    monkeypatch.setattr(store_queries.RE, "recommend", lambda *_: None)
    monkeypatch.setattr(store_queries.CD, "lists", lambda *parts: parts)
    monkeypatch.setattr(store_queries.ST, "current_notes", lambda *_: None)
    note = spark.createDataFrame([(1,)], "note_id long")
    store_queries._lists({"fx_finding_raw": found, "fx_business": None, "fx_contact": None, "fx_note": note})
    assert seen == [card.EVIDENCE]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        store = Store(spark, str(tmp_path), buckets=1)
        rows = spark.range(0, 20000, 1, 8).selectExpr("id as business_id", "'PHONE' as type", "uuid() as value")
        store.save("b1", "2024-01-01 00:00:00", rows.select("business_id"), contact=rows)
        assert len(list(Path(tmp_path, "contact", "bucket=0").glob("*.parquet"))) > 1
        assert store.read("contact").count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
