"""Saved analyses: batches appended once, contacts and list columns of the last analysis.

A batch is one run over some businesses. Its analyses, audits, evidence and recommendations go to a folder of their own per
table, which a repeated run overwrites; contacts and snapshots, which a new analysis replaces, are kept in buckets of
businesses, and only the buckets a batch touches are rewritten. The last step enters the batch in the ledger. Readers take
entered batches only, and of the replaced tables the rows of each business's last entered analysis, so a run that breaks off
leaves what was there, a repeated run leaves the same tables, and an old batch run again late brings nothing back.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

KEY = "business_id"
BUCKETS = 64
_STAMP = "analysis_id string, created_at timestamp, batch string"
APPENDED = {
    "analysis": f"{KEY} bigint, scan_id bigint, status string, website_status string, website_url string, website_source string, "
                "opportunity_score bigint, opportunity_level string, summary string, unverified array<string>, errors array<string>, "
                f"duration_ms bigint, {_STAMP}",
    "audit": f"{KEY} bigint, requested_url string, final_url string, http_status int, technical_score bigint, analysis_complete boolean, "
             f"error_code string, {_STAMP}",
    "evidence": f"{KEY} bigint, code string, category string, severity string, provenance string, confidence string, title string, "
                f"description string, evidence string, {_STAMP}",
    "recommendation": f"{KEY} bigint, position int, code string, product string, title string, priority int, triggered_by string, {_STAMP}",
}
REPLACED = {
    "contact": f"{KEY} bigint, type string, value string, label string, source string, source_url string, provenance string, "
               f"confidence string, {_STAMP}, bucket int",
    "snapshot": f"{KEY} bigint, website_status string, website_url string, opportunity_score bigint, opportunity_level string, "
                f"has_phone boolean, has_email boolean, primary_email string, opportunity_reason string, {_STAMP}, bucket int",
}
_LEDGER = "batch string, created_at timestamp"


def columns_of(ddl: str) -> list[str]:
    return [c.rsplit(" ", 1)[0] for c in ddl.split(", ")]


class Store:
    """Tables under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _read(self, table: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def ledger(self) -> DataFrame:
        return self._read("ledger", _LEDGER)

    def heads(self, besides: str | None = None) -> DataFrame:
        """(business_id, batch) of each business's last entered analysis; a partial aggregate."""
        entered = self.ledger() if besides is None else self.ledger().where(F.col("batch") != besides)
        rows = self._read("analysis", APPENDED["analysis"]).join(entered.select("batch"), "batch", "left_semi")
        return rows.groupBy(KEY).agg(F.max_by("batch", F.struct("created_at", "batch")).alias("batch"))

    def read(self, table: str) -> DataFrame:
        """Visible rows: every entered batch, or the last analysis where a new one replaces the old."""
        if table in APPENDED:
            return self._read(table, APPENDED[table]).join(self.ledger().select("batch"), "batch", "left_semi")
        return self._read(table, REPLACED[table]).drop("bucket").join(self.heads(), [KEY, "batch"], "left_semi")

    def latest(self) -> DataFrame:
        """Each business's last analysis."""
        return self.read("analysis").join(self.heads(), [KEY, "batch"], "left_semi")

    def history(self, limit: int) -> DataFrame:
        """The newest analyses per business, numbered from 1."""
        order = Window.partitionBy(KEY).orderBy(F.desc("created_at"), F.desc("batch"))
        return self.read("analysis").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)

    def _stamped(self, rows: DataFrame, ddl: str, batch: str, created_at: str) -> DataFrame:
        """Columns of the table, those the rows lack as NULL, with the batch's stamp."""
        given = rows.withColumns({
            "analysis_id": F.concat(F.lit(f"{batch}-"), F.col(KEY).cast("string")), "created_at": F.lit(created_at).cast("timestamp"),
            "batch": F.lit(batch), "bucket": F.pmod(F.hash(KEY), F.lit(self.buckets)).cast("int")})
        typed = dict(c.split(" ", 1) for c in ddl.split(", "))
        return given.select(*[(F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in typed.items()])

    def save(self, batch: str, created_at: str, analysis: DataFrame, **more: DataFrame) -> None:
        """Enter one batch: ``analysis`` has one row per analysed business, ``more`` any of the other tables.

        Rows of businesses that the batch did not analyse are refused by a join, so a contact always has its analysis.
        """
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch name consists of letters, digits, dots, dashes and underscores")
        if unknown := set(more) - set(APPENDED) - set(REPLACED):
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        analysed = analysis.select(KEY).distinct()
        for table, ddl in APPENDED.items():
            rows = analysis if table == "analysis" else more.get(table)
            if rows is not None:
                own = self._stamped(rows.join(analysed, KEY, "left_semi"), ddl, batch, created_at).drop("batch")
                own.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")
        for table, ddl in REPLACED.items():
            fresh = more[table].join(analysed, KEY, "left_semi") if table in more else self.spark.createDataFrame([], f"{KEY} bigint")
            self._replace(table, ddl, self._stamped(fresh, ddl, batch, created_at), batch)
        entry = self.spark.createDataFrame([(created_at,)], "at string").select(F.col("at").cast("timestamp").alias("created_at"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")

    def _replace(self, table: str, ddl: str, fresh: DataFrame, batch: str) -> None:
        """Rewrite the buckets the batch touches: entered last rows of all businesses stay beside the new ones until the
        ledger decides; what neither is drops out."""
        path = scratch_path(self.spark, f"replace-{table}")
        fresh.write.parquet(f"{path}/fresh")  # what the rows are made from is run once
        new = self.spark.read.schema(fresh.schema).parquet(f"{path}/fresh")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        kept = self._read(table, ddl).where(F.col("bucket").isin(touched) & (F.col("batch") != batch)).join(
            self.heads(besides=batch), [KEY, "batch"], "left_semi").select(*fresh.columns)
        kept.write.parquet(f"{path}/kept")
        rows = new.unionByName(self.spark.read.schema(fresh.schema).parquet(f"{path}/kept"))
        # a large bucket is written by several tasks, a small one by one
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket").parquet(f"{self.root}/{table}")
