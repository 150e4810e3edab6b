"""Standing questions answered in event time: jobs that hang, follow-ups that fall due, requests while one is pending, scans done.

Events of a key wait in its state until the watermark has passed them, then they are taken in the order of (time, event id), and
alarms between them fire at their own time. So the answer depends on the events alone: one micro-batch or many, and any order
within the lateness, give the same rows. Each alarm and each waiting event sets an event-time timer, which also fires in
batches without input for the key. A key with nothing to wait for has no state.

What is after the last watermark is not decided yet: events and alarms count when their time is before it, to the millisecond.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..rules.vocab import CLOSED_LEADS
from .live import STALE_AFTER_MINUTES

LATENESS = "10 minutes"
_STATE = "kept string, held string"

Row = tuple
Kept = dict


class Machine:
    """What is kept for a key, and how it moves; times are milliseconds."""

    fields = ""  # output columns after the key

    def event(self, kept: Kept, at: int, what: dict) -> Iterator[Row]:
        """Take one event; the rows it causes."""
        raise NotImplementedError

    def alarm(self, kept: Kept) -> int | None:
        """When something happens without an event."""
        return None

    def ring(self, kept: Kept) -> Iterator[Row]:
        """The alarm's time has come."""
        return iter(())


def _moves(machine: Machine, kept: Kept, until: int) -> Iterator[Row]:
    """Rows of all alarms before ``until``."""
    while (alarm := machine.alarm(kept)) is not None and alarm < until:
        yield from machine.ring(kept)


def advance(machine: Machine, kept: Kept, held: list[list], watermark: int) -> tuple[list[Row], list[list]]:
    """Rows caused by what lies before the watermark, and the events that still wait.

    An alarm at the very time of an event rings after it.
    """
    rows: list[Row] = []
    held = sorted(held, key=lambda e: (e[0], e[1]))
    taken = 0
    while taken < len(held) and held[taken][0] < watermark:
        at, _, what = held[taken]
        rows.extend(_moves(machine, kept, at))
        rows.extend(machine.event(kept, at, json.loads(what)))
        taken += 1
    rows.extend(_moves(machine, kept, watermark))
    return rows, held[taken:]


def _runner(machine: Machine, names: list[str]) -> Callable:
    def run(key, frames, state):
        kept, held = map(json.loads, state.get) if state.exists else ({}, [])
        for frame in frames:
            held.extend(map(list, zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["what"].tolist(), strict=True)))
        watermark = max(0, state.getCurrentWatermarkMs())
        rows, held = advance(machine, kept, held, watermark)
        waits = [w for w in (held[0][0] if held else None, machine.alarm(kept)) if w is not None]
        if kept or held:
            state.update((json.dumps(kept), json.dumps(held)))
            if waits:
                state.setTimeoutTimestamp(max(min(waits), watermark + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=names)

    return run


def follow(events: DataFrame, key: str, payload: Column, machine: Machine, lateness: str = LATENESS) -> DataFrame:
    """Rows of ``machine`` for every key of a stream (``event_id``, ``ts``, key)."""
    rows = events.select(key, "ts", F.unix_millis("ts").alias("at"), "event_id", F.to_json(payload).alias("what"))
    kind = events.schema[key].dataType.simpleString()
    names = [key, *[f.strip().split(" ")[0] for f in machine.fields.split(",")]]
    return rows.withWatermark("ts", lateness).groupBy(key).applyInPandasWithState(
        _runner(machine, names), f"{key} {kind}, {machine.fields}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class HangingJobs(Machine):
    """A job that was started and neither ended nor started again within the time allowed."""

    fields = "since bigint, alerted_at bigint"

    def __init__(self, minutes: int = STALE_AFTER_MINUTES):
        self.wait = minutes * 60_000

    def event(self, kept, at, what):
        kept.clear()
        if what["kind"] == "JOB_STARTED":
            kept["since"] = at
        return iter(())

    def alarm(self, kept):
        return kept["since"] + self.wait if "since" in kept else None

    def ring(self, kept):
        since = kept.pop("since")
        yield since, since + self.wait


class FollowUps(Machine):
    """A follow-up that falls due while the lead is open, once per date; a new date arms it anew, an empty one clears it.

    A date that passes while the lead is closed is announced when the lead is opened again.
    """

    fields = "follow_up bigint, alerted_at bigint"

    def event(self, kept, at, what):
        kept["at"] = at
        if what.get("lead_status"):
            kept["closed"] = what["lead_status"] in CLOSED_LEADS
        if what.get("reschedule"):
            kept.pop("due", None)
            if what.get("due") not in (None, kept.get("told")):
                kept["due"] = what["due"]
        return iter(())

    def alarm(self, kept):
        return None if kept.get("closed") or "due" not in kept else max(kept["due"], kept["at"])

    def ring(self, kept):
        at = self.alarm(kept)
        kept["told"] = kept.pop("due")
        yield kept["told"], at


class OneRequest(Machine):
    """Requests while none is pending; a job's end ends the pending one."""

    fields = "event_id bigint, requested_at bigint"

    def event(self, kept, at, what):
        if what["kind"] != "REANALYZE":
            kept.clear()
        elif not kept:
            kept["pending"] = what["id"]
            yield what["id"], at


class ScanDone(Machine):
    """A scan whose jobs are all done or failed, reported once with the counts of the minute that completed it.

    Pieces of one minute are gathered before the check, which rings at the minute's end. The report is remembered for ``days``
    after the scan's last event, so a late retry does not report it again.
    """

    fields = "status string, processed bigint, completed_at bigint"

    def __init__(self, days: int = 30):
        self.keep = days * 86_400_000

    def event(self, kept, at, what):
        kept["last"] = at
        if not kept.get("fired"):
            kept["done"] = kept.get("done", 0) + what["done"]
            kept["failed"] = kept.get("failed", 0) + what["failed"]
            kept["found"], kept["check"] = what["total_found"], at
        return iter(())

    def alarm(self, kept):
        return kept.get("check", kept["last"] + self.keep) if kept else None

    def ring(self, kept):
        if "check" not in kept:
            kept.clear()
            return
        at, processed = kept.pop("check"), kept["done"] + kept["failed"]
        if processed >= kept["found"]:
            kept["fired"] = True
            yield "COMPLETED_WITH_ERRORS" if kept["failed"] else "COMPLETED", processed, at


def _times(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.timestamp_millis(c) for c in columns})


def hanging_jobs(events: DataFrame, minutes: int = STALE_AFTER_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """(business_id, since, alerted_at) for each start that nothing followed in time."""
    jobs = events.where(F.col("kind").isin("JOB_STARTED", "JOB_DONE", "JOB_FAILED"))
    return _times(follow(jobs, "business_id", F.struct("kind"), HangingJobs(minutes), lateness), "since", "alerted_at")


def followup_alerts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(business_id, follow_up, alerted_at) for each follow-up that falls due for an open lead."""
    patches = events.where("kind = 'LEAD_PATCH'")
    contacted = F.when(F.coalesce(F.col("mark_contacted"), F.lit(False)), F.lit("CONTACTED"))
    payload = F.struct(F.coalesce(F.col("lead_status"), contacted).alias("lead_status"), "reschedule", F.unix_millis("follow_up_at").alias("due"))
    return _times(follow(patches, "business_id", payload, FollowUps(), lateness), "follow_up", "alerted_at")


def accepted_requests(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(business_id, event_id, requested_at) of the re-analysis requests that met no pending one."""
    rows = events.where(F.col("kind").isin("REANALYZE", "JOB_DONE", "JOB_FAILED"))
    if events.isStreaming:
        return _times(follow(rows, "business_id", F.struct("kind", F.col("event_id").alias("id")), OneRequest(), lateness), "requested_at")
    before = F.lag("kind").over(Window.partitionBy("business_id").orderBy("ts", "event_id"))
    return rows.withColumn("before", before).where((F.col("kind") == "REANALYZE") & F.coalesce(F.col("before") != "REANALYZE", F.lit(True))).select(
        "business_id", "event_id", F.col("ts").alias("requested_at"))


def _minutes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Job outcomes summed per scan and minute inside the task, ahead of the shuffle."""
    for rows in batches:
        rows["done"] = (rows["kind"] == "JOB_DONE").astype("int64")
        rows["failed"] = (rows["kind"] == "JOB_FAILED").astype("int64")
        yield rows.groupby(["scan_id", "total_found", "ts"], as_index=False)[["done", "failed"]].sum().assign(event_id=0)


def completed_scans(events: DataFrame, lateness: str = LATENESS, keep_days: int = 30) -> DataFrame:
    """(scan_id, status, processed, completed_at): one row per scan, at the end of the minute in which the last job ended.

    Outcomes of a scan are summed per minute before they are shuffled, so a scan with very many jobs sends few rows.
    """
    outcomes = events.where(F.col("kind").isin("JOB_DONE", "JOB_FAILED")).select(
        "scan_id", "kind", "total_found", (F.date_trunc("minute", "ts") + F.expr("interval 1 minute")).alias("ts"))
    summed = outcomes.mapInPandas(_minutes, "scan_id bigint, total_found bigint, ts timestamp, done bigint, failed bigint, event_id bigint")
    payload = F.struct("done", "failed", "total_found")
    return _times(follow(summed, "scan_id", payload, ScanDone(keep_days), lateness), "completed_at")
