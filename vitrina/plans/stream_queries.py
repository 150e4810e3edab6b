"""Streams over the events table and their SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import live as LV
from ..streaming import timeline as TL
from .fixtures import AS_OF, now
from .registry import query

E = "fx_lead_event"
_FOUND = "(50 + scan_id * 3)"


def lead_events(raw: DataFrame) -> DataFrame:
    """The events table read as job outcomes, lead patches and requests."""
    kinds = {"view": "JOB_STARTED", "click": "JOB_DONE", "error": "JOB_FAILED", "purchase": "LEAD_PATCH"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("REANALYZE"))
    sku = F.when(kind == "JOB_STARTED", "google_text_search_enterprise").when(kind == "REANALYZE", "search_brave").otherwise("osm_overpass")
    eid = F.col("event_id")
    return raw.select(
        "event_id", "ts", F.col("user_id").alias("business_id"), kind.alias("kind"), (eid % 40).alias("scan_id"), sku.alias("sku"),
        (50 + (eid % 40) * 3).alias("total_found"),
        F.when(eid % 5 == 0, "WON").when(eid % 5 == 1, "INTERESTED").alias("lead_status"), (eid % 3 == 0).alias("mark_contacted"),
        (eid % 2 == 0).alias("reschedule"), F.when(eid % 4 == 0, F.col("ts") + F.expr("interval 36 hours")).alias("follow_up_at"))


def _stream(t) -> DataFrame:
    return lead_events(LV.read_events(t.spark, f"{t.sf_dir}/events.parquet"))


_LE = """
le as (select event_id, ts, user_id as business_id, case event_type when 'view' then 'JOB_STARTED' when 'click' then 'JOB_DONE' when 'error' then 'JOB_FAILED' when 'purchase' then 'LEAD_PATCH' else 'REANALYZE' end as kind, event_id % 40 as scan_id,
 case event_type when 'view' then 'google_text_search_enterprise' when 'click' then 'osm_overpass' when 'error' then 'osm_overpass' when 'purchase' then 'osm_overpass' else 'search_brave' end as sku,
 case when event_id % 5 = 0 then 'WON' when event_id % 5 = 1 then 'INTERESTED' when event_id % 3 = 0 then 'CONTACTED' end as st, event_id % 3 = 0 as contacted, event_id % 2 = 0 as resched, case when event_id % 4 = 0 then ts + interval 36 hours end as fu from events),
lead as (select business_id, arg_max(st, (ts, event_id)) filter (where st is not null) as lead_status, max(ts) filter (where contacted) as last_contacted_at, max(case when resched then ts end) as rts from le where kind = 'LEAD_PATCH' group by 1),
fup as (select business_id, fu from (select *, row_number() over (partition by business_id order by ts desc, event_id desc) as rn from le where kind = 'LEAD_PATCH' and resched) where rn = 1)
"""


@query("stream_scan_progress", (), "select scan_id, count(*) filter (where kind='JOB_DONE') as analyzed, count(*) filter (where kind='JOB_FAILED') as failed, count(*) as processed, least(100, count(*) * 100 // (50 + scan_id * 3)) as percent from le where kind in ('JOB_DONE','JOB_FAILED') group by scan_id", _LE)
def stream_scan_progress(t):
    rows = LV.run_to_table(LV.scan_progress(_stream(t)), "scan-progress", "update", ["scan_id"])
    return LV.with_percent(rows, 50 + F.col("scan_id") * 3)


@query("stream_scan_done", (), f"select scan_id, case when count(*) filter (where kind='JOB_FAILED') > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end as status, count(*) as processed from le where kind in ('JOB_DONE','JOB_FAILED') group by scan_id having count(*) >= {_FOUND}", _LE)
def stream_scan_done(t):
    return LV.run_to_table(LV.scans_done(_stream(t)), "scan-done", "update")


@query("stream_stale_jobs", (), f"select business_id, strftime(since, '%Y-%m-%d %H:%M:%S') as since from (select business_id, arg_max(kind, (ts, event_id)) as kind, max(ts) as since from le where kind like 'JOB%' group by 1) where kind = 'JOB_STARTED' and since < timestamp '2024-01-31' - interval 10 minutes", _LE)
def stream_stale_jobs(t):
    state = LV.run_to_table(LV.job_state(_stream(t)), "job-state", "update", ["business_id"])
    late = F.lit("2024-01-31").cast("timestamp")
    return LV.stale_jobs(state, late).select("business_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("stream_followups_due", (), f"select business_id, strftime(fu, '%Y-%m-%d %H:%M:%S') as follow_up from lead join fup using (business_id) where fu <= timestamp '{AS_OF}' + interval 13 days and coalesce(lead_status not in ('WON','LOST','DISCARDED'), true)", _LE)
def stream_followups_due(t):
    clock = now() + F.expr("interval 13 days")
    state = LV.run_to_table(LV.lead_state(_stream(t)), "followups", "update", ["business_id"])
    alerts = LV.new_alerts(LV.due_followups(state, clock), None)
    return alerts.select("business_id", F.date_format("next_follow_up_at", "yyyy-MM-dd HH:mm:ss").alias("follow_up"))


@query("stream_request_rate", (), """
select business_id, strftime(ws, '%Y-%m-%d %H:%M') as window_start, count(*) as n from (
 select business_id, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as ws from le) group by 1, 2 having count(*) > 2""", _LE)
def stream_request_rate(t):
    rows = LV.run_to_table(LV.request_rate(_stream(t), "business_id", 2), "request-rate", "update", ["business_id", "window_start"])
    return rows.select("business_id", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("stream_lead_state", (), "select business_id, lead_status, strftime(last_contacted_at, '%Y-%m-%d %H:%M:%S') as contacted, strftime(fu, '%Y-%m-%d %H:%M:%S') as follow_up from lead left join fup using (business_id)", _LE)
def stream_lead_state(t):
    rows = LV.run_to_table(LV.lead_state(_stream(t)), "lead-state", "update", ["business_id"])
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select("business_id", "lead_status", at("last_contacted_at").alias("contacted"), at("next_follow_up_at").alias("follow_up"))


@query("stream_scan_cost", (), "select scan_id, sku, count(*) as n, round(count(*) * case sku when 'google_text_search_enterprise' then 35 when 'search_brave' then 5 else 0 end / 1000.0, 4)::double as cost_usd from le group by 1, 2", _LE)
def stream_scan_cost(t):
    return LV.run_to_table(LV.scan_usage(_stream(t)), "scan-cost", "update", ["scan_id", "sku"])


@query("stream_reanalyze_dedupe", (), "select distinct business_id from le where kind = 'REANALYZE'", _LE)
def stream_reanalyze_dedupe(t):
    # the file arrives as one micro-batch, so the watermark does not expire any key in between
    return LV.run_to_table(LV.reanalyze_requests(_stream(t)), "reanalyze", "append")


_AT = "epoch_ms(ts)"
_END = "(select max(epoch_ms(ts)) - 600000 from le where {})"  # the last watermark: ten minutes behind the newest event
_STAMP = "strftime(make_timestamp({} * 1000), '%Y-%m-%d %H:%M:%S')"


def _shown(rows: DataFrame, *times: str) -> DataFrame:
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


@query("stream_hanging_jobs", (), f"""
select business_id, {_STAMP.format("ms")} as since, {_STAMP.format("(ms + 600000)")} as alerted_at from (
 select business_id, kind, {_AT} as ms, lead({_AT}) over (partition by business_id order by ts, event_id) as nxt from le where kind like 'JOB%')
where kind = 'JOB_STARTED' and coalesce(nxt > ms + 600000, true) and ms + 600000 < {_END.format("kind like 'JOB%'")}""", _LE)
def stream_hanging_jobs(t):
    return _shown(LV.run_to_table(TL.hanging_jobs(_stream(t)), "hanging-jobs", "append"), "since", "alerted_at")


@query("stream_followup_alerts", (), f"""
select business_id, {_STAMP.format("due")} as follow_up, {_STAMP.format("min(greatest(due, ms))")} as alerted_at from (
 select business_id, ms, coalesce(lead(ms) over w, fin) as nxt, coalesce(last_value(case when st is not null then st in ('WON','LOST','DISCARDED') end ignore nulls) over w, false) as closed,
  last_value(case when resched then coalesce(epoch_ms(fu), -1) end ignore nulls) over w as due
 from (select *, {_AT} as ms, {_END.format("kind = 'LEAD_PATCH'")} as fin from le where kind = 'LEAD_PATCH') where ms < fin
 window w as (partition by business_id order by ts, event_id))
where due >= 0 and not closed and greatest(due, ms) < nxt group by business_id, due""", _LE)
def stream_followup_alerts(t):
    return _shown(LV.run_to_table(TL.followup_alerts(_stream(t)), "followup-alerts", "append"), "follow_up", "alerted_at")


_PENDING = f"""
ask as (select business_id, event_id, kind, {_AT} as ms, lag(kind) over (partition by business_id order by ts, event_id) as before from le where kind in ('REANALYZE', 'JOB_DONE', 'JOB_FAILED'))
"""


@query("stream_reanalyze_pending", (), f"""
select business_id, event_id, {_STAMP.format("ms")} as requested_at from ask
where kind = 'REANALYZE' and coalesce(before <> 'REANALYZE', true) and ms < {_END.format("kind in ('REANALYZE', 'JOB_DONE', 'JOB_FAILED')")}""", _LE + "," + _PENDING)
def stream_reanalyze_pending(t):
    return _shown(LV.run_to_table(TL.accepted_requests(_stream(t)), "reanalyze-pending", "append"), "requested_at")


@query("batch_reanalyze_pending", (), f"""
select business_id, event_id, {_STAMP.format("ms")} as requested_at from ask where kind = 'REANALYZE' and coalesce(before <> 'REANALYZE', true)""", _LE + "," + _PENDING)
def batch_reanalyze_pending(t):
    return _shown(TL.accepted_requests(lead_events(t["events"])), "requested_at")


@query("stream_scan_completed", (), f"""
select scan_id, case when failed > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end as status, processed, {_STAMP.format("epoch_ms(minute)")} as completed_at from (
 select scan_id, minute, sum(n) over w as processed, sum(f) over w as failed from (
  select scan_id, date_trunc('minute', ts) + interval 1 minute as minute, count(*) as n, count(*) filter (where kind = 'JOB_FAILED') as f from le where kind in ('JOB_DONE','JOB_FAILED') group by 1, 2)
 window w as (partition by scan_id order by minute))
where processed >= {_FOUND} and epoch_ms(minute) < (select max(epoch_ms(date_trunc('minute', ts) + interval 1 minute)) - 600000 from le where kind in ('JOB_DONE','JOB_FAILED'))
qualify row_number() over (partition by scan_id order by minute) = 1""", _LE)
def stream_scan_completed(t):
    return _shown(LV.run_to_table(TL.completed_scans(_stream(t)), "scan-completed", "append"), "completed_at")
