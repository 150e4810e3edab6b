"""Standing questions over the event stream.

Keyed state is either a streaming aggregate, which combines inside each task before it shuffles, or a one-shot flag per
scan fed by pre-combined counts, so one busy key never sends all its rows to a single task. The same functions run on a
static table and give the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.display import sku_price
from ..rules.vocab import CLOSED_LEADS
from ..session import scratch_path

# --- fixed values: job handling --------------------------------------------------------------
STALE_AFTER_MINUTES = 10
# --- end of fixed values ---------------------------------------------------------------------


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event stream from a folder (or file) of parquet; event time becomes a real timestamp."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # written as a glob, the path may name one file as well as a folder
    source = f"{path[:-1]}[{path[-1]}]"
    return reader.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def _last(value: Column) -> Column:
    """Last non-null value by event time; event id settles ties."""
    at = F.struct("ts", "event_id")
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), at))


def scan_progress(events: DataFrame) -> DataFrame:
    """Analysed, failed and processed jobs per scan."""
    done, failed = F.col("kind") == "JOB_DONE", F.col("kind") == "JOB_FAILED"
    return events.where(done | failed).groupBy("scan_id").agg(
        F.count_if(done).alias("analyzed"), F.count_if(failed).alias("failed"), F.count("*").alias("processed")
    )


def with_percent(progress: DataFrame, found: Column) -> DataFrame:
    return progress.withColumn("percent", F.least(F.lit(100), F.floor(F.col("processed") * 100 / F.greatest(found, F.lit(1)))))


def job_state(events: DataFrame) -> DataFrame:
    """Latest job event per business."""
    kinds = F.col("kind").isin("JOB_STARTED", "JOB_DONE", "JOB_FAILED")
    return events.where(kinds).groupBy("business_id").agg(
        F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("since")
    )


def stale_jobs(state: DataFrame, as_of: Column, minutes: int = STALE_AFTER_MINUTES) -> DataFrame:
    """Jobs started and not finished for too long."""
    return state.where((F.col("kind") == "JOB_STARTED") & (F.col("since") < as_of - F.expr(f"interval {minutes} minutes")))


def lead_state(events: DataFrame) -> DataFrame:
    """Lead patches folded to the current state. Marking a lead contacted sets the status unless the patch names one."""
    contacted = F.coalesce(F.col("mark_contacted"), F.lit(False))
    status = F.coalesce(F.col("lead_status"), F.when(contacted, F.lit("CONTACTED")))
    rescheduled = F.coalesce(F.col("reschedule"), F.lit(False))
    at = F.struct("ts", "event_id")
    return events.where("kind = 'LEAD_PATCH'").groupBy("business_id").agg(
        _last(status).alias("lead_status"),
        F.max(F.when(contacted, F.col("ts"))).alias("last_contacted_at"),
        # an explicit empty follow-up clears the date, so it counts as a value here
        F.max_by(F.when(rescheduled, F.struct(F.col("follow_up_at").alias("v"))), F.when(rescheduled, at)).alias("f"),
    ).select("business_id", "lead_status", "last_contacted_at", F.col("f.v").alias("next_follow_up_at"))


def due_followups(state: DataFrame, as_of: Column) -> DataFrame:
    open_lead = F.coalesce(~F.col("lead_status").isin(CLOSED_LEADS), F.lit(True))
    return state.where((F.col("next_follow_up_at") <= as_of) & open_lead)


def new_alerts(due: DataFrame, sent: DataFrame | None) -> DataFrame:
    """Due follow-ups not yet announced; a new date for the same lead is a new alert."""
    keys = ["business_id", "next_follow_up_at"]
    rows = due.select(*keys)
    return rows if sent is None else rows.join(sent.select(*keys), keys, "left_anti")


def request_rate(events: DataFrame, key: str, limit: int, size: str = "1 hour", slide: str = "30 minutes",
                 lateness: str = "10 minutes") -> DataFrame:
    """Keys with more than ``limit`` events inside a sliding window."""
    stream = events.withWatermark("ts", lateness) if events.isStreaming else events
    counts = stream.groupBy(F.window("ts", size, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(key, F.col("w.start").alias("window_start"), "n")


def scan_usage(events: DataFrame) -> DataFrame:
    """Running calls per scan and SKU with their cost."""
    return events.groupBy("scan_id", "sku").agg(F.count("*").alias("n")).withColumn(
        "cost_usd", F.round(F.col("n") * sku_price(F.col("sku")) / 1000, 4)
    )


def reanalyze_requests(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Re-analysis requests, repeats for one business dropped while one is recent."""
    asked = events.where("kind = 'REANALYZE'")
    if not events.isStreaming:
        return asked.dropDuplicates(["business_id"]).select("business_id")
    return asked.withWatermark("ts", within).dropDuplicatesWithinWatermark(["business_id"]).select("business_id")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Job outcomes summed per scan inside the task, ahead of the shuffle."""
    for rows in batches:
        rows["done"] = (rows["kind"] == "JOB_DONE").astype("int64")
        rows["failed"] = (rows["kind"] == "JOB_FAILED").astype("int64")
        yield rows.groupby(["scan_id", "total_found"], as_index=False)[["done", "failed"]].sum()


def _finish(key, batches, state):
    """Add the counts of one scan; report it once, when everything found is done or failed."""
    done, failed, fired = state.get if state.exists else (0, 0, False)
    found = None
    for rows in batches:
        done += int(rows["done"].sum())
        failed += int(rows["failed"].sum())
        found = int(rows["total_found"].iloc[0])
    if not fired and found is not None and done + failed >= found:
        fired = True
        status = "COMPLETED_WITH_ERRORS" if failed else "COMPLETED"
        yield pd.DataFrame({"scan_id": [key[0]], "status": [status], "processed": [done + failed]})
    state.update((done, failed, fired))


def scans_done(events: DataFrame) -> DataFrame:
    """One completion row per scan (needs ``total_found`` on the events)."""
    outcomes = events.where(F.col("kind").isin("JOB_DONE", "JOB_FAILED")).select("scan_id", "kind", "total_found")
    combined = outcomes.mapInPandas(_combine, "scan_id bigint, total_found bigint, done bigint, failed bigint")
    return combined.groupBy("scan_id").applyInPandasWithState(
        _finish, "scan_id bigint, status string, processed bigint", "done bigint, failed bigint, fired boolean",
        "update", GroupStateTimeout.NoTimeout,
    )


def run_to_table(stream: DataFrame, label: str, mode: str, keys: list[str] | None = None, on_batch=None) -> DataFrame:
    """Drain the available input into a parquet table, one folder per micro-batch, and read it back.

    A repeated micro-batch overwrites its own folder, so retries do not double rows. With ``keys`` the latest row per
    key is returned.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
        if on_batch:
            on_batch(batch, epoch)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(
        availableNow=True
    ).start().awaitTermination()
    table = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{out}/data")
    if not keys:
        return table.drop("epoch")
    cols = [c for c in stream.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select(*keys, "r.*")
