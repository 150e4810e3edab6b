"""Lists, dashboard, agenda, contacts, saved tables and exports: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..operators import contacts as CO
from ..operators import dashboard as DA
from ..operators import export as EX
from ..operators import listing as LI
from ..operators import ordered as OR
from ..operators import scorecard as CA
from ..operators import store as ST
from ..operators import usage as US
from ..rules.categories import CATEGORIES
from ..rules.vocab import PROVIDERS, WEBSITE_STATUSES
from ..session import scratch_path
from .fixtures import AS_OF, now
from .registry import query
from .scoring_queries import ALL, DEDUPED, cards, deduped
from .scoring_queries import business as scored_business
from .sqltext import category_values, values

B, R, C = "fx_business", "fx_finding_raw", "fx_contact"
NOW_SQL = f"timestamp '{AS_OF}'"
OPEN = "lead_status not in ('WON','LOST','DISCARDED')"

_FILTERS = {
    "filter_text": (LI.Filters(q="MAYOR 7"), "lower(name) like '%mayor 7%' or lower(formatted_address) like '%mayor 7%'"),
    "filter_text_accent": (LI.Filters(q="PELUQUERÍA"), "contains(lower(name), 'peluquería') or contains(lower(formatted_address), 'peluquería')"),
    "filter_category": (LI.Filters(category="clinicas"), "category_key = 'clinicas'"),
    "filter_city": (LI.Filters(city="nATion_5"), "lower(city) = 'nation_5'"),
    "filter_website_status": (LI.Filters(website_status="WEB_CAIDA"), "website_status = 'WEB_CAIDA'"),
    "filter_level": (LI.Filters(level="HIGH"), "opportunity_level = 'HIGH'"),
    "filter_lead_status": (LI.Filters(lead_status="TO_CONTACT"), "lead_status = 'TO_CONTACT'"),
    "filter_min_rating": (LI.Filters(min_rating=4.2), "rating >= 4.2"),
    "filter_max_rating": (LI.Filters(max_rating=2.5), "rating <= 2.5"),
    "filter_min_reviews": (LI.Filters(min_reviews=12), "user_rating_count >= 12"),
    "filter_has_phone": (LI.Filters(has_phone=False), "not has_phone"),
    "filter_has_email": (LI.Filters(has_email=True), "has_email"),
    "filter_has_website": (LI.Filters(has_website=True), "website_status <> 'SIN_WEB'"),
    "filter_no_website": (LI.Filters(has_website=False), "website_status = 'SIN_WEB'"),
    "filter_technical_issues": (LI.Filters(technical_issues=True), "technical_issue_count > 0"),
    "filter_info_issues": (LI.Filters(info_issues=False), "consistency_issue_count = 0"),
    "filter_analyzed_between": (
        LI.Filters(analyzed_from="2024-01-05", analyzed_to="2024-01-20"),
        "last_analyzed_at >= timestamp '2024-01-05' and last_analyzed_at < timestamp '2024-01-21'"),
    "filter_follow_up_due": (LI.Filters(follow_up_due=True), f"next_follow_up_at <= {NOW_SQL} and {OPEN}"),
    "filter_combined": (
        LI.Filters(q="mayor", min_rating=2, has_phone=True, has_website=True, technical_issues=True, level="MEDIUM"),
        "lower(formatted_address) like '%mayor%' and rating >= 2 and has_phone and website_status <> 'SIN_WEB' and technical_issue_count > 0 and opportunity_level = 'MEDIUM'"),
}


def _filter_query(key, f, where):
    @query(key, (B,), f"select business_id, name, city, website_status, rating from fx_business where {where}")
    def run(t, f=f):
        return LI.apply_filters(t[B], f, now()).select("business_id", "name", "city", "website_status", "rating")


for _key, (_f, _where) in _FILTERS.items():
    _filter_query(_key, _f, _where)

_SORTS = {
    "sort_default": (LI.Filters(), "opportunity_score desc nulls last, user_rating_count desc nulls last"),
    "sort_default_asc": (LI.Filters(dir="asc"), "opportunity_score asc nulls last, user_rating_count desc nulls last"),
    "sort_name": (LI.Filters(sort="name"), "name asc"),
    "sort_rating": (LI.Filters(sort="rating"), "rating desc nulls last, name asc"),
    "sort_reviews": (LI.Filters(sort="reviews", dir="asc"), "user_rating_count asc nulls last, name asc"),
    "sort_analyzed": (LI.Filters(sort="analyzed"), "last_analyzed_at desc nulls last"),
    "sort_website_score": (LI.Filters(sort="websiteScore"), "website_score desc nulls last"),
    "sort_follow_up": (LI.Filters(sort="followUp"), "next_follow_up_at asc nulls last"),
}


def _sort_query(key, f, order):
    # a page of the sorted list, so that the order itself is compared
    paged = LI.Filters(**{**f.__dict__, "page": 2, "page_size": 40})

    @query(key, (B,), f"select business_id, name from fx_business order by {order}, business_id limit 40 offset 40")
    def run(t):
        return LI.page(t[B], paged)[0].select("business_id", "name")


for _key, (_f, _order) in _SORTS.items():
    _sort_query(_key, _f, _order)


@query("business_page", (B,), f"""
select p.business_id, p.name, n.total from (select * from fx_business where rating >= 3 order by opportunity_score desc nulls last, user_rating_count desc nulls last, business_id limit 50 offset 100) p,
 (select count(*) as total from fx_business where rating >= 3) n""")
def business_page(t):
    f = LI.Filters(min_rating=3, page=3)
    rows, total = LI.page(LI.apply_filters(t[B], f, now()), f)
    one = F.lit(1).alias("k")
    # the total is one row
    return rows.select("business_id", "name", one).join(F.broadcast(total.select("total", one)), "k").drop("k")


@query("join_semi_scan", (B, "fx_scan_business"), """
select business_id, name from fx_business where business_id in (select business_id from fx_scan_business where scan_id in (select o_orderkey from orders where o_orderstatus = 'F'))""")
def join_semi_scan(t):
    scans = t["orders"].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scan_id"))
    links = t["fx_scan_business"].join(scans, "scan_id", "left_semi")
    return LI.in_scan(t[B], links).select("business_id", "name")


@query("filter_scan", (B, "fx_scan_business"), "select business_id from fx_business where business_id in (select business_id from fx_scan_business where scan_id = 77)")
def filter_scan(t):
    return LI.apply_filters(t[B], LI.Filters(scan_id="77"), now(), t["fx_scan_business"]).select("business_id")


@query("dashboard_stats", (B, "fx_scan"), """
select count(last_analyzed_at) as analyzed, count(*) filter (where last_analyzed_at is not null and website_status='SIN_WEB') as no_website,
 count(*) filter (where last_analyzed_at is not null and website_status='WEB_CAIDA') as down, count(*) filter (where last_analyzed_at is not null and website_status='WEB_FUNCIONAL_CON_PROBLEMAS') as problems,
 count(*) filter (where consistency_issue_count > 0) as info_problems, count(*) filter (where has_phone or has_email) as with_contact, count(*) filter (where opportunity_level='HIGH') as high,
 (select round(sum(estimated_cost_usd), 4) from fx_scan) as total_cost from fx_business""")
def dashboard_stats(t):
    return DA.counters(t[B], t["fx_scan"]).withColumn("total_cost", F.round("total_cost", 4))


@query("status_counts", (B,), "select website_status, count(*) as n from fx_business where last_analyzed_at is not null group by 1")
def status_counts(t):
    return DA.status_counts(t[B])


@query("status_by_scan", (B, "fx_scan_business"), "select scan_id, " + ", ".join(
    f"count(*) filter (where website_status = '{s}') as {s.lower()}" for s in WEBSITE_STATUSES) + """,
 count(*) filter (where website_status is null) as pending from fx_scan_business join fx_business using (business_id) group by 1""")
def status_by_scan(t):
    return DA.status_by_scan(t["fx_scan_business"], t[B])


@query("top_opportunities", (B, R, C), f"""
select business_id, name, score as opportunity_score, level as opportunity_level, user_rating_count from lev where {OPEN}
order by score desc, user_rating_count desc nulls last, business_id limit 8""", ALL)
def top_opportunities(t):
    b = scored_business(t)
    scores = cards(t).select("business_id", "opportunity_score", "opportunity_level")
    ranked = b.drop("opportunity_score", "opportunity_level").join(scores, "business_id")
    return DA.top_opportunities(ranked).select(
        "business_id", "name", "opportunity_score", "opportunity_level", "user_rating_count")


@query("due_soon", (B,), f"""
select business_id, name, strftime(next_follow_up_at, '%Y-%m-%d %H:%M') as due from fx_business where next_follow_up_at <= {NOW_SQL} + interval 24 hours and {OPEN} order by next_follow_up_at, business_id limit 5""")
def due_soon(t):
    return DA.due_soon(t[B], now()).select("business_id", "name", F.date_format("next_follow_up_at", "yyyy-MM-dd HH:mm").alias("due"))


@query("recent_scans", ("fx_scan",), "select scan_id, status, estimated_cost_usd from fx_scan order by created_at desc, scan_id desc limit 100")
def recent_scans(t):
    return DA.recent_scans(t["fx_scan"], 100).select("scan_id", "status", "estimated_cost_usd")


@query("distinct_cities", (B,), "select distinct city from fx_business")
def distinct_cities(t):
    return DA.cities(t[B])


@query("followup_agenda", (B,), f"""
select business_id, bucket from (
 (select business_id, 'overdue' as bucket from fx_business where {OPEN} and next_follow_up_at < {NOW_SQL} )
 union all select business_id, 'today' from fx_business where {OPEN} and next_follow_up_at >= {NOW_SQL} and next_follow_up_at < timestamp '2024-01-16'
 union all (select business_id, 'upcoming' from fx_business where {OPEN} and next_follow_up_at >= timestamp '2024-01-16' )
 union all (select business_id, 'to_contact' from fx_business where lead_status = 'TO_CONTACT' and next_follow_up_at is null))""")
def followup_agenda(t):
    return DA.agenda(t[B], now()).select("business_id", "bucket")


@query("scan_outcome", (B, "fx_scan", "fx_scan_business"), """
select s.scan_id, case when status = 'ANALYZING' and total_analyzed + total_failed >= total_found then case when total_failed > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end else status end as status,
 total_analyzed + total_failed as processed, case when status = 'ANALYZING' and total_analyzed + total_failed >= total_found then coalesce(h.n, 0) end as high
from fx_scan s left join (select scan_id, count(*) as n from fx_scan_business join fx_business using (business_id) where opportunity_level = 'HIGH' group by 1) h using (scan_id)""")
def scan_outcome(t):
    return DA.scan_outcome(t["fx_scan"], t["fx_scan_business"], t[B])


@query("job_health", ("fx_job",), f"""
select scan_id, count(*) filter (where status='QUEUED') as queued, count(*) filter (where status='RUNNING') as running, count(*) filter (where status='FAILED') as failed,
 count(*) filter (where status='FAILED' and finished_at >= {NOW_SQL} - interval 1 day) as failed_24h from fx_job group by 1""")
def job_health(t):
    return DA.job_counts(t["fx_job"], now(), "scan_id")


@query("live_workers", (), f"select user_id as worker_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_beat from events where ts <= timestamp '2024-01-15 12:00:00' group by 1 having max(ts) >= {NOW_SQL} - interval 7200 seconds")
def live_workers(t):
    beats = t["events"].select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp").alias("beat_at")).where(F.col("beat_at") <= now())
    return DA.live_workers(beats, now(), 7200).select("worker_id", F.date_format("last_beat_at", "yyyy-MM-dd HH:mm:ss").alias("last_beat"))


@query("analysis_history", ("fx_analysis",), """
select business_id, analysis_id, status, opportunity_score, position from (select *, row_number() over (partition by business_id order by created_at desc, analysis_id desc) as position from fx_analysis) where position <= 20""")
def analysis_history(t):
    return DA.history(t["fx_analysis"]).select("business_id", "analysis_id", "status", "opportunity_score", F.col("position").cast("bigint").alias("position"))


@query("contacts_union", (C,), """
select business_id, type, value, source, seq from (select *, row_number() over (partition by business_id, type, lower(value) order by seq) as rn from fx_contact) where rn = 1""")
def contacts_union(t):
    return CO.merge(t[C]).select("business_id", "type", "value", "source", "seq")


@query("primary_contacts", (C,), """
select business_id, bool_or(type='PHONE') as has_phone, arg_min(value, seq) filter (where type='EMAIL') as primary_email, arg_min(value, seq) filter (where type='INSTAGRAM') as instagram_url,
 arg_min(value, seq) filter (where type='FACEBOOK') as facebook_url, arg_min(value, seq) filter (where type='WHATSAPP') as whatsapp_url
from (select *, row_number() over (partition by business_id, type, lower(value) order by seq) as rn from fx_contact) where rn = 1 group by 1""")
def primary_contacts(t):
    return CO.primary(CO.merge(t[C]))


@query("first_phone", (C,), "select business_id, arg_min(value, seq) as first_phone from fx_contact where type = 'PHONE' group by 1")
def first_phone(t):
    return CO.first_phone(t[C])


@query("usage_merge", ("fx_scan_usage",), "select scan_id, sku, sum(n)::bigint as n from fx_scan_usage group by 1, 2")
def usage_merge(t):
    return US.merged(t["fx_scan_usage"]).select("scan_id", "sku", F.col("n").cast("bigint").alias("n"))


@query("scan_cost", ("fx_scan_usage",), """
select scan_id, round(sum(n * case sku when 'google_text_search_pro' then 32 when 'google_text_search_enterprise' then 35 when 'google_text_search_enterprise_atmosphere' then 40 when 'search_brave' then 5 else 0 end) / 1000.0, 4)::double as estimated_cost_usd from fx_scan_usage group by 1""")
def scan_cost(t):
    return US.cost(t["fx_scan_usage"])


@query("business_card", (B, R, C, "fx_analysis", "fx_note"), """
select b.business_id, b.name, a.analysis_id, a.status as analysis_status, coalesce(f.n,0) as findings, coalesce(c.n,0) as contacts, coalesce(o.n,0) as notes from fx_business b
left join (select * from (select *, row_number() over (partition by business_id order by created_at desc, analysis_id desc) as rn from fx_analysis) where rn = 1) a using (business_id)
left join (select business_id, count(distinct code) as n from fx_finding_raw group by 1) f using (business_id)
left join (select business_id, count(*) as n from fx_contact group by 1) c using (business_id)
left join (select business_id, count(*) as n from fx_note where note_id % 9 <> 0 group by 1) o using (business_id)""")
def business_card(t):
    notes = ST.current_notes(t["fx_note"], t["fx_note"].where("note_id % 9 = 0"))
    card = ST.business_card(t[B], t["fx_analysis"], deduped(t), t[C], notes)
    return card.select("business_id", "name", "analysis_id", "analysis_status", "findings", "contacts", "notes")


@query("business_snapshot", (B, R, C, "fx_analysis"), """
select l.business_id, website_status, case when l.business_id % 3 <> 0 then provider_website end as website_url, score as opportunity_score, level as opportunity_level, i.t as technical_issue_count, i.c as content_issue_count,
 i.f as consistency_issue_count, ph as has_phone, em as has_email, p.e as primary_email, r.reason as opportunity_reason, a.analysis_id as latest_analysis_id
from lev l join (select business_id, count(code) filter (where severity <> 'INFO' and category in ('AVAILABILITY','SECURITY','PERFORMANCE','SEO','MOBILE','ACCESSIBILITY','UX')) as t,
  count(code) filter (where severity <> 'INFO' and category in ('CONTENT','CONTACT')) as c, count(code) filter (where severity <> 'INFO' and category in ('FRESHNESS','CONSISTENCY','REVIEWS')) as f
  from fx_business left join ded using (business_id) group by 1) i using (business_id)
left join (select business_id, arg_min(value, seq) filter (where type='EMAIL') as e from fx_contact group by 1) p using (business_id)
left join (select business_id, arg_max(analysis_id, (created_at, analysis_id)) as analysis_id from fx_analysis group by 1) a using (business_id)
left join (select business_id, string_agg('+' || round(points)::bigint || ' ' || reason, '; ' order by rn) as reason from (
 select *, row_number() over (partition by business_id order by points desc, ord) as rn from allparts where points > 0) where rn <= 3 group by 1) r using (business_id)""", ALL)
def business_snapshot(t):
    b = scored_business(t).withColumns({
        "website_url": F.col("provider_website"),
        "website_source": F.when(F.col("business_id") % 3 == 0, "none").otherwise("provider")})
    rows = cards(t).withColumn("opportunity_reason", CA.reason()).drop("parts")
    snap = ST.card_snapshot(b, rows, CO.merge(t[C]), t["fx_analysis"])
    return snap.select("business_id", "website_status", "website_url", "opportunity_score", "opportunity_level", "technical_issue_count",
                       "content_issue_count", "consistency_issue_count", "has_phone", "has_email", "primary_email",
                       "opportunity_reason", "latest_analysis_id")


@query("contacts_replace", (C,), """
select business_id, type, value from fx_contact where source = 'listing' and business_id not in (select business_id from fx_contact where source = 'website')
union all select business_id, type, value from fx_contact where source = 'website'""")
def contacts_replace(t):
    fresh = t[C].where("source = 'website'")
    return ST.replace_contacts(t[C].where("source = 'listing'"), fresh, fresh).select("business_id", "type", "value")


_PURGE = ["formatted_address", "street", "postal_code", "national_phone", "business_status"]


@query("retention_purge", (B,), f"""
select business_id, name, lead_status, purged, case when purged then null else rating end as rating, case when purged then null else lat end as lat, {', '.join(f'case when purged then null else {c} end as {c}' for c in _PURGE)}
from (select *, provider_key = 'google_places' and provider_fetched_at < {NOW_SQL} - interval 30 days as purged from fx_business)""")
def retention_purge(t):
    return ST.purge_listing(t[B], now()).select("business_id", "name", "lead_status", "purged", "rating", "lat", *_PURGE)


@query("provider_upsert", (), f"""
select coalesce(k.key, c.key) as key, coalesce(k.name, c.name) as name, coalesce(k.kind, c.kind) as kind from
 (select case s_suppkey when 0 then 'osm' when 1 then 'brave' else 'extra-' || s_suppkey end as key, s_name as name, 'OLD' as kind from supplier) c
 full join (select * from (values {values(PROVIDERS)}) as v(key, name, kind, notes)) k on k.key = c.key""")
def provider_upsert(t):
    key = F.col("s_suppkey")
    current = t["supplier"].select(
        F.when(key == 0, "osm").when(key == 1, "brave").otherwise(F.concat(F.lit("extra-"), key.cast("string"))).alias("key"),
        F.col("s_name").alias("name"), F.lit("OLD").alias("kind"), F.lit("").alias("notes"))
    known = current.sparkSession.createDataFrame(PROVIDERS, "key string, name string, kind string, notes string")
    return ST.upsert_providers(current, known).select("key", "name", "kind")


@query("notes_current", ("fx_note",), "select note_id, business_id, body from fx_note where note_id % 9 <> 0")
def notes_current(t):
    return ST.current_notes(t["fx_note"], t["fx_note"].where("note_id % 9 = 0")).select("note_id", "business_id", "body")


_EXPORT_BASE = f"""
cats(category_key, label_es, nb, nm) as (values {category_values()}),
lim as (select * from fx_business where has_phone or rating >= 3),
exp as (select b.business_id, name as nombre, label_es as categoria, city as ciudad, formatted_address as direccion, coalesce(provider_website, '') as web,
 case website_status when 'SIN_WEB' then 'Sin web' when 'WEB_CAIDA' then 'Web caída' when 'WEB_FUNCIONAL_CON_PROBLEMAS' then 'Web con problemas' when 'WEB_ACEPTABLE' then 'Web aceptable' when 'WEB_NO_VERIFICABLE' then 'No verificable' else 'Sin analizar' end as estado_web,
 coalesce(opportunity_score::varchar, '') as opportunity_score,
 case opportunity_level when 'HIGH' then 'Alta oportunidad' when 'MEDIUM' then 'Oportunidad media' when 'LOW' then 'Oportunidad baja' when 'INSUFFICIENT_EVIDENCE' then 'Evidencia insuficiente' else '' end as nivel_oportunidad,
 coalesce(website_score::varchar, '') as website_score, coalesce(p.titles, '') as problemas,
 coalesce(substr(national_phone,1,3) || ' ' || substr(national_phone,4,2) || ' ' || substr(national_phone,6,2) || ' ' || substr(national_phone,8), f.ph, '') as telefono,
 coalesce('(40) motivo; (3) ' || city, '') as motivo_oportunidad,
 case lead_status when 'NEW' then 'Nuevo' when 'TO_CONTACT' then 'Por contactar' when 'CONTACTED' then 'Contactado' when 'INTERESTED' then 'Interesado' when 'PROPOSAL_SENT' then 'Propuesta enviada' when 'WON' then 'Cliente' when 'LOST' then 'Perdido' else 'Descartado' end as estado_comercial,
 coalesce(strftime(next_follow_up_at, '%Y-%m-%d'), '') as proximo_seguimiento, coalesce(strftime(last_analyzed_at, '%Y-%m-%d'), '') as fecha_analisis
 from lim b left join cats using (category_key)
 left join (select business_id, string_agg(title, ' | ' order by sev_rank, seq) as titles from (select *, row_number() over (partition by business_id order by sev_rank, seq) as rn from ded where severity in ('CRITICAL','HIGH','MEDIUM')) where rn <= 6 group by 1) p using (business_id)
 left join (select business_id, arg_min(value, seq) as ph from fx_contact where type = 'PHONE' group by 1) f using (business_id))
"""


def _export(t):
    rows = LI.apply_filters(t[B], LI.Filters(), now()).where(F.col("has_phone") | (F.col("rating") >= 3))
    rows = rows.withColumn(
        "opportunity_reason", F.concat(F.lit("+40 motivo; +3 "), F.col("city")))
    return EX.export_rows(rows, deduped(t), t[C])


@query("export_rows", (B, R, C), "select *, '' as email, '' as whatsapp, '' as instagram, '' as facebook, '' as maps from exp", DEDUPED + "," + _EXPORT_BASE)
def export_rows(t):
    return _export(t)


_CSV_LINES = """
select business_id, concat_ws(';', """ + ", ".join(
    "''" if c in ("email", "whatsapp", "instagram", "facebook", "maps") else
    f"""case when contains(z.{c}, '"') or contains(z.{c}, ';') then '"' || replace(z.{c}, '"', '""') || '"' else z.{c} end""" for c in EX.EXPORT_COLUMNS) + """) as line from (
 select business_id, """ + ", ".join(
    f"case when regexp_matches(trim({c}), '^[=+@-]') then '''' || trim({c}) else trim({c}) end as {c}" for c in EX.EXPORT_COLUMNS if c not in ("email", "whatsapp", "instagram", "facebook", "maps")) + " from exp) z"


@query("export_csv_lines", (B, R, C), _CSV_LINES, DEDUPED + "," + _EXPORT_BASE)
def export_csv_lines(t):
    return EX.csv_lines(_export(t))


@query("export_json_manifest", (B,), "select '2024-01-15T12:00:00.000Z' as generated_at, count(*) as count from fx_business where has_phone or rating >= 3")
def export_json_manifest(t):
    return EX.manifest(t[B].where(F.col("has_phone") | (F.col("rating") >= 3)), now())


_LISTED = """,
pos as (select business_id, row_number() over (order by b.opportunity_score desc nulls last, b.user_rating_count desc nulls last, business_id) as position from fx_business b where has_phone or rating >= 3)"""


@query("export_file_lines", (B, R, C), f"""
select position // 1000 as part, line from ({_CSV_LINES}) join pos using (business_id)
union all select 0, '{";".join(EX.EXPORT_COLUMNS)}'""", DEDUPED + "," + _EXPORT_BASE.rstrip() + _LISTED)
def export_file_lines(t):
    """The file itself, written in the order of the list and read back: which lines stand in which part (Spark's reader drops the mark)."""
    rows = LI.apply_filters(t[B], LI.Filters(), now()).where(F.col("has_phone") | (F.col("rating") >= 3))
    rows = rows.withColumn("opportunity_reason", F.concat(F.lit("+40 motivo; +3 "), F.col("city")))
    path = scratch_path(t.spark, "export")
    run = OR.export_file(rows, deduped(t), t[C], LI.order_by(LI.Filters()), path, now(), rows_per_part=1000)
    return OR.file_lines(t.spark, path, run)


@query("list_positions", (B,), """
select business_id, row_number() over (order by rating desc nulls last, name nulls last, business_id) as position from fx_business""")
def list_positions(t):
    return OR.in_order(t[B], LI.order_by(LI.Filters(sort="rating"))).select("business_id", "position")


@query("relative_time", (B,), f"""
select business_id, case when due_at is null then '—' when g >= 86400 then p || (g // 86400) || ' día' || case when g // 86400 > 1 then 's' else '' end
 when g >= 3600 then p || (g // 3600) || ' hora' || case when g // 3600 > 1 then 's' else '' end when g >= 60 then p || (g // 60) || ' minuto' || case when g // 60 > 1 then 's' else '' end else 'ahora' end as due,
 case when amount is null then '—' when amount > 0 and amount < 0.01 then '<0,01 $' else replace(printf('%.2f', case when amount * 8 = floor(amount * 8) then round(amount, 2) else amount end), '.', ',') || ' $' end as price
from (select business_id, next_follow_up_at as due_at, abs(epoch({NOW_SQL}) - epoch(next_follow_up_at))::bigint as g, case when next_follow_up_at > {NOW_SQL} then 'en ' else 'hace ' end as p,
 case when business_id % 5 = 0 then null else (business_id % 300) / 400.0::double end as amount from fx_business)""")
def relative_time(t):
    amount = F.when(F.col("business_id") % 5 == 0, None).otherwise((F.col("business_id") % 300) / 400.0)
    return t[B].select("business_id", D.relative_time(F.col("next_follow_up_at"), now()).alias("due"), D.money(amount).alias("price"))


@query("labels", (B,), f"select business_id, label_es as es, label_en as en from fx_business join (values {values([(c[0], c[1], c[2]) for c in CATEGORIES])}) as v(category_key, label_es, label_en) using (category_key)")
def labels(t):
    key = F.col("category_key")
    return t[B].select("business_id", D.category_label(key).alias("es"), D.category_label(key, "en").alias("en"))


