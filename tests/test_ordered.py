"""Lists in order: positions against a sort, files read byte by byte, broken-off and repeated runs."""

import csv
import io
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrina.operators import export as EX
from vitrina.operators import ordered as OR

BUSINESS = ("business_id long, name string, category_key string, city string, formatted_address string, provider_website string, website_status string, "
            "opportunity_score int, opportunity_level string, website_score int, national_phone string, country_code string, lead_status string, "
            "next_follow_up_at timestamp, last_analyzed_at timestamp")
FINDING = "business_id long, code string, title string, severity string, sev_rank int, seq int, category string"
CONTACT = "business_id long, seq int, type string, value string"


def lists(spark, n):
    rng = random.Random(3)
    names = ["Bar; Pepe", 'El "Gallo"', "=SUM(A1)", "línea\ndos", "Ñu", ""]
    rows = [(i, rng.choice(names), None, "Sevilla", None, None, None, rng.choice([None, 1, 2, 3]), None, None, None, "ES", "NEW", None, None) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, BUSINESS), spark.createDataFrame([], FINDING), spark.createDataFrame([], CONTACT)


def at():
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def order():
    return [F.col("opportunity_score").desc_nulls_last(), F.col("business_id").asc()]


def wanted(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[7] is None, -(r[7] or 0), r[0]))]


def text(folder):
    return b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*"))).decode("utf-8")


def test_positions(spark):
    rows, business, _, _ = lists(spark, 700)
    for parts in (1, 7):
        got = OR.in_order(business, order(), parts).orderBy("position").collect()
        assert [r["business_id"] for r in got] == wanted(rows) and [r["position"] for r in got] == list(range(1, 701))
    page = OR.first(business, order(), 20, 333).orderBy("position").collect()
    assert [r["business_id"] for r in page] == wanted(rows)[333:353]
    assert OR.in_order(business.limit(0), order()).count() == 0


def test_repeated_rows_and_odd_names(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "b"), (None, "a"), (2, None)], "`a.b` long, _n string")
    got = OR.in_order(rows, [F.col("`a.b`").asc_nulls_last()], 3).orderBy("position").collect()
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "b", 1), (1, "b", 2), (2, None, 3), (None, "a", 4)]


def test_csv_file(spark, tmp_path):
    rows, business, findings, contacts = lists(spark, 130)
    path = str(tmp_path / "out")
    business = business.withColumn("opportunity_reason", F.concat(F.lit("+3 n"), F.col("business_id").cast("string")))
    OR.export_file(business, findings, contacts, order(), path, at(), run="r1", rows_per_part=50)
    raw = text(f"{path}/r1")
    assert raw.startswith("﻿nombre;") and raw.endswith("\r\n") and "línea dos" in raw and "'=SUM(A1)" in raw
    cells = list(csv.DictReader(io.StringIO(raw[1:], newline=""), delimiter=";"))
    assert [c["motivo_oportunidad"] for c in cells] == [f"(3) n{i}" for i in wanted(rows)]
    assert len(list(Path(f"{path}/r1").glob("part-*"))) == 3
    OR.export_file(business, findings, contacts, order(), path, at(), run="r2", limit=7)
    assert text(f"{path}/r2").count("\r\n") == 8 and text(f"{path}/r2") == "".join(raw.splitlines(True)[:8])
    assert {r["run"]: r["count"] for r in OR.manifest(spark, path).collect()} == {"r1": 130, "r2": 7}
    OR.export_file(business, findings, contacts, order(), path, at(), run="r1", rows_per_part=50)
    assert text(f"{path}/r1") == raw and OR.manifest(spark, path).count() == 2


def test_json_file(spark, tmp_path):
    rows, business, findings, contacts = lists(spark, 60)
    path = str(tmp_path / "out")
    business = business.withColumn("opportunity_reason", F.col("business_id").cast("string"))
    for data, n in ((business, 60), (business.limit(0), 0)):
        run = OR.export_file(data, findings, contacts, order(), path, at(), form="json", rows_per_part=25)
        whole = json.loads(text(f"{path}/{run}"))
        assert whole["generatedAt"] == "2024-01-15T12:00:00.000Z" and whole["count"] == n
        assert [r["motivo_oportunidad"] for r in whole["rows"]] == [str(i) for i in wanted(rows)][:n]
        assert all(list(r) == EX.EXPORT_COLUMNS for r in whole["rows"])


def test_a_broken_off_file_is_not_entered(spark, tmp_path, monkeypatch):
    _, business, findings, contacts = lists(spark, 5)
    path = str(tmp_path / "out")
    assert OR.manifest(spark, path).count() == 0

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(OR, "write_parts", fail)
        with pytest.raises(RuntimeError):
            OR.export_file(business, findings, contacts, order(), path, at(), run="r1")
    assert OR.manifest(spark, path).count() == 0
    for run in ("a/b", "..", "manifest", ""):
        if run:
            with pytest.raises(ValueError):
                OR.export_file(business, findings, contacts, order(), path, at(), run=run)
    with pytest.raises(ValueError):
        OR.export_file(business, findings, contacts, order(), path, at(), form="xlsx")
