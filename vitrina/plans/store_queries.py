"""Saved analyses and business cards: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import card as CD
from ..operators import findings as FI
from ..operators import recommend as RE
from ..operators import store as ST
from ..operators.dashboard import latest
from ..operators.persist import Store
from ..session import scratch_path
from .registry import query
from .scoring_queries import ALL, RECS

B, R, C = "fx_business", "fx_finding_raw", "fx_contact"


@query("analysis_append", (B, R, C), """
select 'analysis' as tbl, business_id, batch || '-' || business_id as analysis_id, website_status as item from run
union all select 'evidence', business_id, r.batch || '-' || business_id, f.code || ' ' || f.severity from run r join fx_finding_raw f using (business_id) where r.batch = 'b1' or f.sev_rank < 3
union all select 'contact', business_id, l.batch || '-' || business_id, c.type || ' ' || c.value from last l join fx_contact c using (business_id) where l.batch = 'b1' or c.source = 'website'
union all select 'snapshot', business_id, l.batch || '-' || business_id, opportunity_level from last l""", """
run as (select *, 'b1' as batch from fx_business where business_id % 3 <> 2 union all select *, 'b2' as batch from fx_business where business_id % 3 <> 0),
last as (select * from run qualify row_number() over (partition by business_id order by batch desc) = 1)""")
def analysis_append(t):
    """Two batches over overlapping businesses; the first one is run again after the second."""
    store = Store(t.spark, scratch_path(t.spark, "analyses"), buckets=8)

    def batch(name, at, business, evidence, contacts):
        store.save(name, at, business, evidence=evidence, contact=contacts, snapshot=business)

    first = ("b1", "2024-01-01 00:00:00", t[B].where("business_id % 3 <> 2"), t[R], t[C])
    batch(*first)
    batch("b2", "2024-01-02 00:00:00", t[B].where("business_id % 3 <> 0"), t[R].where("sev_rank < 3"), t[C].where("source = 'website'"))
    batch(*first)
    item = {"analysis": F.col("website_status"), "evidence": F.concat_ws(" ", "code", "severity"), "contact": F.concat_ws(" ", "type", "value"),
            "snapshot": F.col("opportunity_level")}
    parts = [store.read(name).select(F.lit(name).alias("tbl"), "business_id", "analysis_id", text.alias("item")) for name, text in item.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_NOTES = """
noted as (select *, row_number() over (partition by business_id order by created_at desc, note_id desc) as position from fx_note where note_id % 9 <> 0)
"""


def _lists(t):
    notes = ST.current_notes(t["fx_note"], t["fx_note"].where("note_id % 9 = 0"))
    evidence = FI.dedupe(t[R].select(*CD.EVIDENCE))
    return CD.lists(evidence, RE.recommend(t[B], evidence), t[C], notes)


@query("business_card_lists", (B, R, C, "fx_note"), """
select business_id, 'evidence' as section, row_number() over (partition by business_id order by sev_rank, seq, code, title) as position, code as kind, title as text, severity as detail from ded where code is not null
union all select business_id, 'recommendations', row_number() over (partition by business_id order by priority, place), code, title, priority::varchar from recs
union all select business_id, 'contacts', row_number() over (partition by business_id order by seq, type, value), type, value, source from fx_contact
union all select business_id, 'notes', position, 'note', body, strftime(created_at, '%Y-%m-%d %H:%M:%S') from noted""", ALL + RECS + "," + _NOTES)
def business_card_lists(t):
    return _lists(t).withColumn("position", F.col("position").cast("bigint"))


@query("business_card_full", (B, R, C, "fx_note", "fx_analysis", "fx_job"), """
select b.business_id, a.analysis_id, a.status, e.list as evidence, n.list as notes, c.n as contacts, coalesce(p.pending, false) as pending from fx_business b
left join (select business_id, arg_max(analysis_id, (created_at, analysis_id)) as analysis_id, arg_max(status, (created_at, analysis_id)) as status from fx_analysis group by 1) a using (business_id)
left join (select business_id, string_agg(code, ',' order by sev_rank, seq, code) as list from ded where code is not null group by 1) e using (business_id)
left join (select business_id, string_agg(body, ',' order by position) as list from noted group by 1) n using (business_id)
left join (select business_id, count(*) as n from fx_contact group by 1) c using (business_id)
left join (select distinct business_id, true as pending from fx_job where status in ('QUEUED', 'RUNNING')) p using (business_id)""", ALL + "," + _NOTES)
def business_card_full(t):
    last = latest(t["fx_analysis"])
    audit = t[B].select("business_id", F.col("provider_website").alias("requested_url"), "website_score")
    cards = CD.cards(t[B], last, audit, _lists(t), t["fx_job"].select("business_id", "status"))
    shown = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda i: i[f]), ","))
    return cards.select("business_id", "analysis.analysis_id", "analysis.status", shown(F.col("evidence"), "kind").alias("evidence"),
                        shown(F.col("notes"), "text").alias("notes"), F.when(F.size("contacts") > 0, F.size("contacts")).cast("bigint").alias("contacts"), "pending")
