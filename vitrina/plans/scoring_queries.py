"""Findings, scores and recommendations: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as FI
from ..operators import recommend as RE
from ..operators import scorecard as CA
from ..operators import scoring as SC
from ..operators import weights as WE
from ..rules import scoring as S
from ..rules.recommendations import HIDDEN_WITHOUT_SITE, NEW_SITE_OFFERS, REC_RULES, THIRD_PARTY_CODES
from .registry import query
from .sqltext import category_values, quoted, values

B, R, C = "fx_business", "fx_finding_raw", "fx_contact"

DEDUPED = """
ded as (select business_id, code, first_seq as seq, sev_rank, severity, category, title, description, confidence, provenance
 from (select *, min(seq) over (partition by business_id, code) as first_seq,
   row_number() over (partition by business_id, code order by sev_rank, seq) as rn from fx_finding_raw) where rn = 1)
"""
TECH = quoted(FI.TECHNICAL_CATEGORIES)
CONTENT = quoted(FI.CONTENT_CATEGORIES)
THIRD = quoted(THIRD_PARTY_CODES)

WEB = f""",
webraw as (select d.*, case severity when 'CRITICAL' then 15.0 when 'HIGH' then 7.0 when 'MEDIUM' then 3.0 when 'LOW' then 0.5 else 0 end::double as raw,
  case website_status when 'WEB_ACEPTABLE' then 8 else 35 end::double as cap
 from ded d join fx_business b using (business_id)
 where website_status in ('WEB_ACEPTABLE','WEB_FUNCIONAL_CON_PROBLEMAS') and (category in ({TECH}) or category in ({CONTENT}) or code = 'FREE_SUBDOMAIN')),
webrun as (select *, coalesce(sum(raw) over (partition by business_id order by raw desc, sev_rank, seq rows between unbounded preceding and 1 preceding), 0) as used from webraw where raw > 0),
web as (select *, least(raw, greatest(cap - used, 0)) as points from webrun where used < cap)
"""
CONS = """,
crule(place, code, raw) as (values """ + values(
    [(i, c, float(p)) for i, (c, p) in enumerate(S.CONSISTENCY_POINTS.items())]) + """),
crun as (select d.*, r.place, r.raw, coalesce(sum(r.raw) over (partition by business_id order by r.place rows between unbounded preceding and 1 preceding), 0) as used
 from ded d join crule r using (code)),
cons as (select *, least(raw, 20 - used)::double as points from crun where used < 20)
"""
REV = f""",
rrun as (select *, case when code in ({quoted(S.STRONG_REVIEW_CODES)}) then 4 else 2 end as raw from ded where category = 'REVIEWS'),
rrun2 as (select *, coalesce(sum(raw) over (partition by business_id order by sev_rank, seq rows between unbounded preceding and 1 preceding), 0) as used from rrun),
rev as (select *, least(raw, 10 - used)::double as points from rrun2 where used < 10)
"""
WIDE = f""",
cat(category_key, label_es, needs_booking, needs_menu) as (values {category_values()}),
ff as (select business_id,
  min(case when code in ({THIRD}) then sev_rank * 1e15 + seq end) as third_at, bool_or(code in ({THIRD})) as third,
  arg_min(title, sev_rank * 1e15 + seq) filter (where code in ({THIRD})) as third_title,
  arg_min(code, sev_rank * 1e15 + seq) filter (where code in ({THIRD})) as third_code,
  arg_min(code, seq) filter (where category = 'AVAILABILITY' and severity = 'CRITICAL') as cause_code,
  arg_min(description, seq) filter (where category = 'AVAILABILITY' and severity = 'CRITICAL') as cause_text,
  bool_or(category = 'AVAILABILITY' and severity = 'CRITICAL' and confidence = 'HIGH') as sure,
  bool_or(code = 'NO_ONLINE_BOOKING') as nb, bool_or(code = 'REVIEW_ONLINE_BOOKING') as rb,
  bool_or(code in ('NO_MENU','MENU_PDF_ONLY')) as nm, bool_or(code = 'PROBABLE_PUBLIC_ENTITY') as pub
 from ded group by 1),
cf as (select business_id, bool_or(type='PHONE') as ph, bool_or(type='EMAIL') as em, bool_or(type='CONTACT_FORM') as fo, bool_or(type='WHATSAPP') as wa,
  bool_or(type='CONTACT_PAGE') as pg, bool_or(type in ('INSTAGRAM','FACEBOOK','TIKTOK','LINKEDIN','X','YOUTUBE')) as so from fx_contact group by 1),
wide as (select b.*, coalesce(third, false) as third, third_title, third_code, cause_code, cause_text, coalesce(sure,false) as sure, coalesce(nb,false) as nb, coalesce(rb,false) as rb,
  coalesce(nm,false) as nm, coalesce(pub,false) as pub, coalesce(ph,false) as ph, coalesce(em,false) as em, coalesce(fo,false) as fo, coalesce(wa,false) as wa, coalesce(pg,false) as pg, coalesce(so,false) as so,
  label_es, needs_booking, needs_menu, coalesce(website_status in ('SIN_WEB','WEB_CAIDA'), false) as nosite
 from fx_business b left join ff using (business_id) left join cf using (business_id) left join cat using (category_key)),
wide2 as (select *, needs_booking and (nosite or nb or rb) as want_booking, needs_menu and (nosite or nm) as want_menu,
  case when coalesce(user_rating_count,0) >= 100 then 15 when coalesce(user_rating_count,0) >= 30 then 10 when coalesce(user_rating_count,0) >= 10 then 6 when coalesce(user_rating_count,0) >= 1 then 3 else 0 end as tier from wide)
"""
PARTS = """,
parts as (
 select business_id, 0 as ord, 'website' as component, 40.0 as points, case when third then 'Sin web propia (' || lower(third_title) || ')' else 'No se ha encontrado web oficial' end as reason, coalesce(third_code, 'NO_WEBSITE') as codes, false as inferred from wide2 where website_status = 'SIN_WEB'
 union all select business_id, 0, 'website', 40.0, 'La web publicada no funciona' || case when cause_text is not null then ' (' || lower(cause_text) || ')' else '' end, cause_code, false from wide2 where website_status = 'WEB_CAIDA'
 union all select business_id, 1000000 + row_number() over (partition by business_id order by raw desc, sev_rank, seq), 'website', points, title, code, provenance = 'INFERRED' from web where severity <> 'LOW'
 union all select business_id, 2000000, 'website', least(count(*) * 0.5, any_value(cap)), count(*)::varchar || ' mejora(s) menor(es) (SEO/UX)', string_agg(code, ',' order by seq), false from web where severity = 'LOW' group by business_id
 union all select business_id, 3000000 + place, 'consistency', points, title, code, provenance = 'INFERRED' from cons
 union all select business_id, 4000000 + row_number() over (partition by business_id order by sev_rank, seq), 'consistency', points, title, code, true from rev
 union all select business_id, 5000000, 'presence', tier, 'Negocio con actividad de clientes (' || coalesce(user_rating_count,0)::varchar || ' reseñas en ' || case provider_key when 'google_places' then 'Google' else 'el proveedor' end || ')', null, false from wide2 where tier > 0
 union all select business_id, 6000000, 'contact', 6, 'Teléfono disponible', null, false from wide2 where ph
 union all select business_id, 7000000, 'contact', 2, 'Email empresarial publicado', null, false from wide2 where em
 union all select business_id, 8000000, 'contact', 2, case when wa then 'WhatsApp publicado' else 'Formulario de contacto' end, null, false from wide2 where fo or wa
 union all select business_id, 9000000, 'need', 5, case when want_booking then 'Categoría que suele depender de reservas/citas online (' else 'Categoría en la que la carta/menú online es clave (' end || label_es || ')', case when want_booking and nb then 'NO_ONLINE_BOOKING' end, true from wide2 where want_booking or want_menu
 union all select business_id, 10000000, 'penalty', -15, 'Cerrado temporalmente según el proveedor', null, false from wide2 where business_status = 'CLOSED_TEMPORARILY'),
sums as (select business_id, sum(points)::double as total, sum(case when component = 'website' then points else 0 end)::double as webpts from parts group by 1),
allparts as (select * from parts union all
 select business_id, 11000000, 'penalty', -total, 'Cerrado permanentemente según el proveedor', null, false from sums join fx_business using (business_id) where business_status = 'CLOSED_PERMANENTLY' and total <> 0)
"""
SCORED = """,
sc as (select w.*, coalesce(total, 0) as total, coalesce(webpts, 0) as webpts,
  case when business_status = 'CLOSED_PERMANENTLY' then 0 else greatest(0, least(100, round(coalesce(total,0))))::bigint end as score,
  least(100, 35 + case when website_status = 'SIN_WEB' then case when third or search_checked then 30 when provider_key = 'google_places' then 20 else 0 end
    when website_status = 'WEB_CAIDA' then case when sure then 35 else 20 end when website_status = 'WEB_NO_VERIFICABLE' then 0
    else case when analysis_complete then 35 else 15 end end
   + case when reviews_analyzed >= 3 then 10 else 0 end + case when user_rating_count is not null or national_phone is not null then 10 else 0 end)::bigint as conf
 from wide2 w left join sums using (business_id)),
lev as (select *, case when business_status = 'CLOSED_PERMANENTLY' then 'LOW' when pub then 'LOW'
  when website_status = 'SIN_WEB' and not third and not search_checked and provider_key = 'osm' then 'INSUFFICIENT_EVIDENCE'
  when conf < 40 then 'INSUFFICIENT_EVIDENCE' when website_status = 'WEB_NO_VERIFICABLE' and score < 60 then 'INSUFFICIENT_EVIDENCE'
  when score >= 60 then 'HIGH' when score >= 40 then 'MEDIUM' else 'LOW' end as level from sc)
"""
ALL = DEDUPED + WEB + CONS + REV + WIDE + PARTS + SCORED


def business(t):
    return t[B].withColumn("technical_score", F.col("website_score"))


def deduped(t):
    return FI.dedupe(t[R])


def cards(t, weights=None):
    return CA.scorecard(business(t), deduped(t), t[C], weights)


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query("findings_dedupe", (R,), "select business_id, code, seq, severity, confidence, title from ded", DEDUPED)
def findings_dedupe(t):
    return deduped(t).select("business_id", "code", "seq", "severity", "confidence", "title")


@query("findings_union", (R, B), f"""
select business_id, code, severity from (
 select *, row_number() over (partition by business_id, code order by sev_rank, seq) as rn from (
  select business_id, code, severity, sev_rank, seq from fx_finding_raw
  union all select business_id, 'NO_WEBSITE', 'HIGH', 1, -1 from fx_business where website_status = 'SIN_WEB'
  union all select business_id, 'BUSINESS_' || business_status, 'INFO', 4, -1 from fx_business where business_status in ('CLOSED_PERMANENTLY','CLOSED_TEMPORARILY')
  union all select business_id, 'PROBABLE_PUBLIC_ENTITY', 'INFO', 4, -1 from fx_business
   where regexp_matches(trim(name), '(?i)^(ayuntamiento|centro de salud|comisar[ií]a|biblioteca (municipal|p[uú]blica))'))) where rn = 1
""")
def findings_union(t):
    listing = FI.emit(
        t[B].withColumn("no_site", F.col("website_status") == "SIN_WEB"),
        RE.listing_rules(F.col("no_site"), F.lit(False), F.lit("")), ["business_id"], base_seq=-100,
    )
    rows = FI.union_all(t[R].drop("sev_rank"), listing)
    return FI.dedupe(rows).select("business_id", "code", "severity")


@query("severity_counts", (R,), """
select business_id, count(*) filter (where severity='CRITICAL') as n_critical, count(*) filter (where severity='HIGH') as n_high,
 count(*) filter (where severity='MEDIUM') as n_medium, count(*) filter (where severity='LOW') as n_low, count(*) filter (where severity='INFO') as n_info
from ded group by 1""", DEDUPED)
def severity_counts(t):
    return FI.severity_counts(deduped(t))


@query("technical_score", (R,), """
select business_id, greatest(0, least(100, 100 - sum(case severity when 'CRITICAL' then 30 when 'HIGH' then 15 when 'MEDIUM' then 7 when 'LOW' then 2 else 0 end)))::bigint as technical_score
from ded group by 1""", DEDUPED)
def technical_score(t):
    return FI.technical_score(deduped(t))


@query("issue_counts", (R,), f"""
select business_id, count(*) filter (where category in ({TECH}) and severity <> 'INFO') as technical_issue_count,
 count(*) filter (where category in ({CONTENT}) and severity <> 'INFO') as content_issue_count,
 count(*) filter (where category in ('FRESHNESS','CONSISTENCY','REVIEWS') and severity <> 'INFO') as consistency_issue_count
from ded group by 1""", DEDUPED)
def issue_counts(t):
    return FI.issue_counts(deduped(t))


@query("score_web_points", (R, B), "select business_id, code, points from web", DEDUPED + WEB)
def score_web_points(t):
    return SC.web_points(business(t), deduped(t)).select("business_id", "code", "points")


@query("score_consistency", (R,), "select business_id, code, points from cons", DEDUPED + CONS)
def score_consistency(t):
    return SC.consistency_points(deduped(t)).select("business_id", "code", "points")


@query("score_reviews", (R,), "select business_id, code, points from rev", DEDUPED + REV)
def score_reviews(t):
    return SC.review_points(deduped(t)).select("business_id", "code", "points")


@query("contact_score", (C,), """
select business_id, (40 * max((type='PHONE')::int) + 25 * max((type='EMAIL')::int) + 10 * max((type='CONTACT_FORM')::int) + 10 * max((type='WHATSAPP')::int)
 + 5 * max((type='CONTACT_PAGE')::int) + 10 * max((type in ('INSTAGRAM','FACEBOOK','TIKTOK','LINKEDIN','X','YOUTUBE'))::int))::bigint as contact_score
from fx_contact group by 1""")
def contact_score(t):
    return SC.contact_score(SC.contact_facts(t[C]))


@query("evidence_confidence", (B, R, C), "select business_id, conf as evidence_confidence from sc", ALL)
def evidence_confidence(t):
    return cards(t).select("business_id", "evidence_confidence")


@query("score_presence_contact_need", (B, R, C), """
select business_id, component, sum(points)::double as points from allparts where component in ('presence','contact','need') group by 1, 2""", ALL)
def score_presence_contact_need(t):
    return (
        CA.contributions(cards(t)).where(F.col("component").isin("presence", "contact", "need"))
        .groupBy("business_id", "component").agg(F.sum("points").alias("points"))
    )


@query("opportunity_score", (B, R, C), """
select business_id, score as opportunity_score, level as opportunity_level, evidence as evidence_confidence from (select *, conf as evidence from lev)""", ALL)
def opportunity_score(t):
    return cards(t).select(
        "business_id", "opportunity_score", "opportunity_level", "evidence_confidence")


def _weighed(sql: str) -> str:
    """The score's SQL with the points of the rule table where it names built-in ones."""
    point = "(select points from fx_weight w where w.kind = '{}' and w.key = {})".format
    swaps = [
        ("case severity when 'CRITICAL' then 15.0 when 'HIGH' then 7.0 when 'MEDIUM' then 3.0 when 'LOW' then 0.5 else 0 end::double", point("severity", "severity")),
        ("case website_status when 'WEB_ACEPTABLE' then 8 else 35 end::double", point("cap", "website_status")),
        ("count(*) * 0.5", f"count(*) * any_value({point('severity', chr(39) + 'LOW' + chr(39))})"),
        ("(values " + values([(i, c, float(p)) for i, (c, p) in enumerate(S.CONSISTENCY_POINTS.items())]) + ")",
         "(select place, key, points from fx_weight where kind = 'consistency')"),
        ("'website' as component, 40.0 as points", f"'website' as component, {point('status', chr(39) + 'SIN_WEB' + chr(39))} as points"),
        ("6000000, 'contact', 6,", f"6000000, 'contact', {point('contact', chr(39) + 'phone' + chr(39))},"),
        ("when score >= 60 then 'HIGH'", f"when score >= {point('level', chr(39) + 'HIGH' + chr(39))} then 'HIGH'"),
    ]
    for old, new in swaps:
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


@query("opportunity_score_weighted", (B, R, C, "fx_weight"), """
select business_id, score as opportunity_score, level as opportunity_level from lev""", _weighed(ALL))
def opportunity_score_weighted(t):
    """Scores under the weights of a rule table instead of the built-in ones."""
    return cards(t, WE.load(t["fx_weight"])).select("business_id", "opportunity_score", "opportunity_level")


@query("score_components", (B, R, C), """
select business_id, round(webpts / 40 * 100)::bigint as website_opportunity, website_score::bigint as technical_score, consistency_score::bigint as consistency_score,
 (40 * ph::int + 25 * em::int + 10 * fo::int + 10 * wa::int + 5 * pg::int + 10 * so::int)::bigint as contact_score, conf as evidence_confidence
from lev""", ALL)
def score_components(t):
    return cards(t).select(
        "business_id", *big("website_opportunity", "technical_score", "consistency_score", "contact_score",
                            "evidence_confidence"))


@query("score_contributions", (B, R, C), """
select business_id, component, points::double as points, reason, codes, inferred from allparts""", ALL)
def score_contributions(t):
    return CA.contributions(cards(t)).drop("ord")


@query("level_reason", (B, R, C), """
select business_id, case when business_status = 'CLOSED_PERMANENTLY' then 'closed' when pub then 'public' when level = 'INSUFFICIENT_EVIDENCE' then 'evidence'
 when score >= 60 then 'Score ' || score || ' ≥ 60' when score >= 40 then 'Score ' || score || ' entre 40 y 59' else 'Score ' || score || ' < 40' end as why from lev""", ALL)
def level_reason(t):
    s = cards(t)
    r = F.col("level_reason")
    return s.select("business_id", F.when(r.startswith("Negocio cerrado"), "closed").when(
        r.startswith("Posible entidad"), "public").when(
        F.col("opportunity_level") == "INSUFFICIENT_EVIDENCE", "evidence").otherwise(r).alias("why"))


@query("opportunity_reason", (B, R, C), """
select business_id, string_agg('+' || round(points)::bigint || ' ' || reason, '; ' order by rn) as opportunity_reason from (
 select *, row_number() over (partition by business_id order by points desc, ord) as rn from allparts where points > 0) where rn <= 3 group by 1""", ALL)
def opportunity_reason(t):
    return cards(t).select("business_id", CA.reason().alias("opportunity_reason")).where("opportunity_reason is not null")


TRIGGERS = values([(i, r.code, r.title, c) for i, r in enumerate(REC_RULES) for c in r.triggers])
OFFERS = values([(i, o[0], o[2], o[3], o[4] or "") for i, o in enumerate(NEW_SITE_OFFERS)])
RECS = f""",
trig(place, rec, title, code) as (values {TRIGGERS}),
offer(place, rec, title, priority, needs) as (values {OFFERS}),
recs as (
 select d.business_id, 100 + t.place as place, t.rec as code, any_value(t.title) as title, least(5, min(sev_rank) + 1) as priority,
  string_agg(d.code, ',' order by tp) as triggered_by
 from ded d join (select *, row_number() over () as tp from trig) t on t.code = d.code join fx_business b using (business_id)
 where not (b.website_status is not distinct from 'SIN_WEB' and t.rec in ({quoted(HIDDEN_WITHOUT_SITE)})) group by 1, 2, 3
 union all
 select w.business_id, o.place, o.rec, o.title, o.priority, coalesce(third_code, 'NO_WEBSITE') from wide2 w join offer o
  on o.needs = '' or (o.needs = 'booking' and needs_booking) or (o.needs = 'menu' and needs_menu) where w.website_status = 'SIN_WEB')
"""


@query("recommendations", (B, R, C), """
select business_id, code, title, priority::bigint as priority, triggered_by, row_number() over (partition by business_id order by priority, place) as position from recs""",
       ALL + RECS)
def recommendations(t):
    return RE.recommend(t[B], deduped(t)).select(
        "business_id", "code", "title", *big("priority"), "triggered_by", *big("position"))


@query("analysis_summary", (B, R), """
select b.business_id, case b.website_status when 'SIN_WEB' then 'Sin web' when 'WEB_CAIDA' then 'Web caída' when 'WEB_FUNCIONAL_CON_PROBLEMAS' then 'Web con problemas'
  when 'WEB_ACEPTABLE' then 'Web aceptable' else 'No verificable' end || ': motivo.'
 || coalesce(' Problemas importantes: ' || s.t || '.', '')
 || case when coalesce(c.n, 0) > 0 then ' Señales de información posiblemente desactualizada o inconsistente: ' || c.n || '.' else '' end
 || case when user_rating_count > 0 then ' ' || user_rating_count || ' reseñas en Google.' else '' end as summary
from fx_business b
left join (select business_id, string_agg(lower(title), '; ' order by sev_rank, seq) as t from (select *, row_number() over (partition by business_id order by sev_rank, seq) as rn from ded
  where severity in ('CRITICAL','HIGH') and code not in ('NO_WEBSITE','WEBSITE_IS_THIRD_PARTY')) where rn <= 3 group by 1) s using (business_id)
left join (select business_id, count(*) as n from ded where category in ('CONSISTENCY','FRESHNESS') group by 1) c using (business_id)
where b.website_status is not null""", DEDUPED)
def analysis_summary(t):
    b = t[B].where("website_status is not null").withColumn("status_reason", F.lit("motivo"))
    return RE.summary(b, deduped(t)).select("business_id", "summary")


@query("unverified_notes", (B, C), """
select business_id, note from (
 select business_id, 'Email empresarial: no encontrado en fuentes públicas (no se generan emails por patrón).' as note from fx_business where business_id not in (select business_id from fx_contact where type='EMAIL')
 union select business_id, 'Teléfono: no encontrado.' from fx_business where business_id not in (select business_id from fx_contact where type='PHONE')
 union select business_id, case provider_key when 'google_places' then 'Reseñas: no disponibles para este negocio o no solicitadas (GOOGLE_PLACES_FETCH_REVIEWS).' else 'Reseñas: el proveedor utilizado no ofrece reseñas.' end from fx_business where reviews_analyzed = 0
 union select business_id, 'No se ha comprobado en buscadores si existe una web no enlazada en la ficha (SEARCH_PROVIDER no configurado).' from fx_business where not search_checked and website_status is not distinct from 'SIN_WEB')""")
def unverified_notes(t):
    return RE.unverified_notes(t[B], SC.contact_facts(t[C]))


@query("analysis_header", (B,), """
select business_id, case when not analysis_complete then 'PARTIAL' else 'COMPLETED' end as status from fx_business""")
def analysis_header(t):
    return t[B].select("business_id", RE.analysis_status(F.lit(0), F.col("analysis_complete")).alias("status"))


@query("public_entity", (B,), """
select business_id from fx_business where regexp_matches(regexp_replace(name, '^\\s+|\\s+$', '', 'g'), '(?i)^(ayuntamiento|centro de salud|comisar[ií]a|biblioteca (municipal|p[uú]blica))')""")
def public_entity(t):
    from ..functions.text import public_entity as is_public
    return t[B].where(is_public(F.col("name"))).select("business_id")


@query("export_problems", (R,), """
select business_id, string_agg(title, ' | ' order by sev_rank, seq) as titles from (
 select *, row_number() over (partition by business_id order by sev_rank, seq) as rn from ded where severity in ('CRITICAL','HIGH','MEDIUM')) where rn <= 6 group by 1""", DEDUPED)
def export_problems(t):
    return FI.top_titles(deduped(t), "business_id", ["CRITICAL", "HIGH", "MEDIUM"], 6)


@query("top_problems", (R,), """
select business_id, string_agg(title, ' | ' order by sev_rank, seq) as titles from (
 select *, row_number() over (partition by business_id order by sev_rank, seq) as rn from ded where severity in ('CRITICAL','HIGH','MEDIUM') and category not like 'REVIEW%') where rn <= 3 group by 1""", DEDUPED)
def top_problems(t):
    return FI.top_titles(deduped(t), "business_id", ["CRITICAL", "HIGH", "MEDIUM"], 3, skip_category="REVIEWS")
