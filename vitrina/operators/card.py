"""A business's card: the last analysis with its audit, and the ordered lists attached to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "business_id"
SECTIONS = ["evidence", "recommendations", "contacts", "notes"]
PENDING = ["QUEUED", "RUNNING"]
EVIDENCE = [KEY, "code", "title", "severity", "sev_rank", "seq"]  # of a finding, what a card shows and orders by


def _items(rows: DataFrame, section: str, kind: Column, text: Column, detail: Column, *order: Column) -> DataFrame:
    first, second = [*order, F.lit(0)][:2]
    return rows.select(KEY, F.lit(section).alias("section"), F.struct(first.cast("bigint").alias("a"), second.cast("bigint").alias("b")).alias("at"),
                       kind.alias("kind"), text.alias("text"), detail.cast("string").alias("detail"))


def lists(evidence: DataFrame, recommendations: DataFrame, contacts: DataFrame, notes: DataFrame) -> DataFrame:
    """(business_id, section, position, kind, text, detail): evidence by severity, offers by priority, contacts as found,
    notes newest first. One row per item, so a business with very many notes stays many rows."""
    c = F.col
    rows = (
        _items(evidence, "evidence", c("code"), c("title"), c("severity"), c("sev_rank"), c("seq"))
        .unionByName(_items(recommendations, "recommendations", c("code"), c("title"), c("priority"), c("priority"), c("position")))
        .unionByName(_items(contacts, "contacts", c("type"), c("value"), c("source"), c("seq")))
        .unionByName(_items(notes, "notes", F.lit("note"), c("body"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"),
                            -F.unix_micros(c("created_at").cast("timestamp")), -c("note_id")))
    )
    place = F.row_number().over(Window.partitionBy(KEY, "section").orderBy("at", "kind", "text"))
    return rows.withColumn("position", place).drop("at")


def cards(business: DataFrame, latest: DataFrame, audit: DataFrame, items: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per business of ``business`` (those to show): its columns, ``analysis`` and ``audit`` structs, one array per
    section, ``pending`` when a job waits or runs.

    A card holds its lists whole; ``lists`` is the form for tables.
    """
    wanted = business.select(KEY)
    item = F.struct("position", "kind", "text", "detail")
    grouped = items.join(wanted, KEY, "left_semi").groupBy(KEY).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("section") == s, item))).alias(s) for s in SECTIONS])
    fields = lambda df, name: df.select(KEY, F.struct(*[c for c in df.columns if c != KEY]).alias(name))
    waiting = jobs.where(F.col("status").isin(PENDING)).select(KEY).distinct().withColumn("pending", F.lit(True))
    card = business
    for part in (fields(latest, "analysis"), fields(audit, "audit"), grouped, waiting):
        card = card.join(part, KEY, "left")
    none = F.array().cast(grouped.schema[SECTIONS[0]].dataType)
    return card.withColumns({**{s: F.coalesce(s, none) for s in SECTIONS}, "pending": F.coalesce("pending", F.lit(False))})
