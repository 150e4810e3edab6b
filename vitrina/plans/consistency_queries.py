"""Reviews and listing-versus-website comparison: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as CN
from ..operators import reviews as RV
from ..rules.regex import ansi
from ..rules.reviews import REVIEW_PATTERNS
from .fixtures import now
from .registry import query
from .sqltext import values
from .text_queries import WS, _match_snip

B, H, V = "fx_business", "fx_hours", "fx_review"

_SIG = "sig as (" + " union all ".join(
    f"select business_id, review_id, seq, {i} as place, '{p.category}' as category, {_match_snip('text', p.pattern, 60)} as ev from fx_review where regexp_matches(text, {ansi(p.pattern)})"
    for i, p in enumerate(REVIEW_PATTERNS)) + f"""),
sig2 as (select *, case when length(ev) <= 160 then ev else regexp_replace(substr(ev, 1, 159), '{WS}+$', '') || '…' end as evidence from sig),
pat(category, label, conf, strong) as (values {values([(p.category, p.label, p.confidence, p.strong) for p in REVIEW_PATTERNS])})"""


@query("review_signals", (V,), "select business_id, review_id, category, evidence from sig2", _SIG)
def review_signals(t):
    return RV.signals(t[V]).select("business_id", "review_id", "category", "evidence")


@query("review_findings", (V,), """
select business_id, 'REVIEW_' || s.category as code, case when any_value(strong) then 'MEDIUM' else 'LOW' end as severity, case when count(*) >= 2 then 'HIGH' when any_value(conf) = 'HIGH' then 'MEDIUM' else 'LOW' end as confidence,
 'Reseñas: ' || lower(any_value(label)) || ' (' || count(*) || ')' as title, string_agg(evidence, ' | ' order by seq, review_id) filter (where rn <= 3) as evidence
from (select *, row_number() over (partition by business_id, category order by seq, review_id) as rn from sig2) s join pat using (category) group by business_id, s.category""", _SIG)
def review_findings(t):
    return RV.review_findings(RV.signals(t[V])).select("business_id", "code", "severity", "confidence", "title", "evidence")


_CLOCK = "case when regexp_matches({x}, '^[0-9]{{1,2}}:[0-9][0-9]') then lpad(regexp_extract({x}, '^([0-9]{{1,2}}):', 1), 2, '0') || ':' || regexp_extract({x}, ':([0-9][0-9])', 1) else {x} end"
_O, _C = _CLOCK.format(x="open_at"), _CLOCK.format(x="close_at")
_DAYS = f"""
sp as (select distinct business_id, day, side, {_O} || '-' || case when {_C} in ('00:00','23:59') then '24:00' else {_C} end as span from fx_hours),
dy as (select business_id, day, side, string_agg(span, ', ' order by span) as txt, list(span) as spans from sp group by 1, 2, 3),
mn as (select *, split_part(split_part(span,'-',1),':',1)::int * 60 + split_part(split_part(span,'-',1),':',2)::int as o, split_part(split_part(span,'-',2),':',1)::int * 60 + split_part(split_part(span,'-',2),':',2)::int as c from sp where side = 'website'),
ov as (select business_id, day, coalesce(bool_or(o < prev), false) as crosses from (select *, lag(case when c <= o then c + 1440 else c end) over (partition by business_id, day order by o, case when c <= o then c + 1440 else c end) as prev from mn) group by 1, 2),
cmp as (select business_id, day, coalesce(a.txt, 'cerrado') as listing, coalesce(b.txt, 'cerrado') as website, coalesce(a.txt, 'cerrado') <> coalesce(b.txt, 'cerrado') as differs,
  coalesce(a.txt, 'cerrado') <> coalesce(b.txt, 'cerrado') and coalesce(crosses, false) as contradictory, a.spans as asp, b.spans as bsp
 from (select * from dy where side = 'listing') a full join (select * from dy where side = 'website') b using (business_id, day) left join ov using (business_id, day)
 where business_id in (select business_id from dy where side = 'listing') and business_id in (select business_id from dy where side = 'website')),
cmp2 as (select *, differs and not (contradictory and coalesce(list_has_all(bsp, asp), false)) as mismatch from cmp)
"""


def _sides(t):
    return t[H].where("side = 'listing'"), t[H].where("side = 'website'")


@query("hours_by_day", (H,), "select business_id, side, day, txt as spans from dy", _DAYS)
def hours_by_day(t):
    return CN.hours_by_day(t[H], "business_id", "side").withColumn("spans", F.array_join("spans", ", "))


@query("hours_overlap", (H,), "select business_id, day, crosses from ov", _DAYS)
def hours_overlap(t):
    return CN.hours_by_day(_sides(t)[1], "business_id").select("business_id", "day", CN.spans_overlap(F.col("spans")).alias("crosses"))


@query("hours_consistency", (H,), "select business_id, day, listing, website, differs, contradictory, mismatch from cmp2", _DAYS)
def hours_consistency(t):
    return CN.compare_hours(*_sides(t))


def _facts(t):
    """Comparison inputs derived from the business keys."""
    k = F.col("business_id")
    empty = F.array().cast("array<string>")
    one = F.concat(F.lit("+34"), F.col("national_phone"))
    b = t[B].select(
        "business_id", "provider_key", "business_status", "national_phone", "country_code", "postal_code", "street",
        F.lit(None).cast("string").alias("international_phone"),
        F.when(k % 5 == 0, empty).when((k % 5 == 1) & one.isNotNull(), F.array(one)).when(k % 5 == 2, F.array(F.lit("+34911111111"), F.lit("+34922222222")))
        .otherwise(F.array(F.lit("+34933333333"))).alias("site_phones"),
        F.when(k % 5 == 3, F.array(F.lit("944 444 444"), F.lit("no"), F.lit("955 555 555"))).otherwise(empty).alias("schema_phones"),
        F.when(k % 7 == 0, F.array(F.lit("41003"))).otherwise(empty).alias("schema_postal_codes"),
        F.when(k % 7 == 1, F.array(F.lit("41001"), F.lit("41002"))).otherwise(empty).alias("postal_codes"),
        F.when(k % 7 < 5, F.array(F.when(k % 2 == 0, "C/ MAYOR, 3").otherwise("Avenida Sur 9"))).otherwise(empty).alias("address_texts"),
        F.when(k % 9 == 1, "cerrado").alias("temp_closed_text"), F.when(k % 9 == 2, "covid").alias("covid_text"),
        (k % 9 % 3).alias("dated_count"), (2015 + k % 9).alias("oldest_year"), F.when(k % 3 == 1, 2010 + k % 15).alias("latest_copyright"),
        (now() - F.make_dt_interval((k % 1500).cast("int"))).alias("sitemap_lastmod"),
    )
    days = CN.compare_hours(*_sides(t))
    verdict = CN.hours_verdict(days).withColumn("hours_compared", F.lit(True))
    joined = b.join(verdict, "business_id", "left").fillna(False, ["hours_compared"]).fillna(0, ["contradictory_days", "mismatch_days"])
    return CN.address_facts(CN.phone_facts(joined))


_CF = _DAYS + """,
cf0 as (select b.*, business_id as k, case business_id % 5 when 0 then [] when 1 then case when national_phone is not null then ['+34' || national_phone] else ['+34933333333'] end when 2 then ['+34911111111','+34922222222'] when 3 then ['+34933333333','+34944444444','+34955555555'] else ['+34933333333'] end as wp,
  case when business_id % 7 = 0 then ['41003'] when business_id % 7 = 1 then ['41001','41002'] else [] end as pc, business_id % 7 = 0 as structured, business_id % 7 < 5 as has_text, business_id % 2 = 0 as mayor,
  coalesce(cd, 0) as cd, coalesce(md, 0) as md, hd is not null as hc
 from fx_business b left join (select business_id, count(*) filter (where contradictory) as cd, count(*) filter (where mismatch) as md, 1 as hd from cmp2 group by 1) using (business_id)),
cf as (select *, case when national_phone is not null and len(wp) > 0 then case when list_contains(wp, '+34' || national_phone) then 'match' else 'mismatch' end when len(wp) > 0 then 'missing_in_provider' when national_phone is not null then 'missing_in_website' else 'not_comparable' end as phone_result,
  case when postal_code is not null and len(pc) > 0 then case when list_contains(pc, postal_code) then 'match' else 'mismatch' end when street is not null and has_text then case when mayor then 'match' else 'not_comparable' end else 'not_comparable' end as address_result,
  (postal_code is not null and len(pc) > 0) or (street is not null and has_text) as address_compared from cf0),
cons as (
 select business_id, 'PHONE_MISMATCH' as code, 'MEDIUM' as severity, case when len(wp) <= 2 then 'MEDIUM' else 'LOW' end as confidence, 25 as pen from cf where phone_result = 'mismatch'
 union all select business_id, 'PROVIDER_MISSING_PHONE', 'LOW', 'HIGH', 5 from cf where phone_result = 'missing_in_provider'
 union all select business_id, 'ADDRESS_MISMATCH', case when structured then 'MEDIUM' else 'LOW' end, case when structured then 'MEDIUM' else 'LOW' end, case when structured then 25 else 10 end from cf where address_result = 'mismatch'
 union all select business_id, 'WEBSITE_HOURS_CONTRADICTORY', 'LOW', 'HIGH', 10 from cf where cd > 0
 union all select business_id, 'HOURS_MISMATCH', 'MEDIUM', 'MEDIUM', 20 from cf where md > 0
 union all select business_id, 'STATUS_CONFLICT', 'MEDIUM', 'MEDIUM', 20 from cf where k % 9 = 1 and coalesce(business_status, 'OPERATIONAL') = 'OPERATIONAL'
 union all select business_id, 'STALE_COVID_NOTICE', 'MEDIUM', 'MEDIUM', 15 from cf where k % 9 = 2
 union all select business_id, 'OLD_DATED_CONTENT', case when k % 9 % 3 >= 2 or 2015 + k % 9 <= 2021 then 'MEDIUM' else 'LOW' end, case when k % 9 % 3 >= 2 or 2015 + k % 9 <= 2021 then 'MEDIUM' else 'LOW' end, case when k % 9 % 3 >= 2 or 2015 + k % 9 <= 2021 then 15 else 8 end from cf where k % 9 % 3 > 0
 union all select business_id, 'OLD_COPYRIGHT', 'LOW', 'LOW', 5 from cf where k % 3 = 1 and 2010 + k % 15 <= 2021
 union all select business_id, 'SITEMAP_STALE', 'LOW', 'MEDIUM', 5 from cf where k % 1500 > 730)
"""


@query("phone_consistency", (B, H), "select business_id, phone_result, array_to_string(wp, ',') as web_phones from cf", _CF)
def phone_consistency(t):
    return _facts(t).select("business_id", "phone_result", F.array_join("web_phones", ",").alias("web_phones"))


@query("address_consistency", (B, H), "select business_id, address_result, address_compared from cf", _CF)
def address_consistency(t):
    return _facts(t).select("business_id", "address_result", "address_compared")


@query("finding_rules_consistency", (B, H), "select business_id, code, severity, confidence from cons", _CF)
def finding_rules_consistency(t):
    return CN.consistency_findings(_facts(t), now()).select("business_id", "code", "severity", "confidence")


@query("consistency_score", (B, H), """
select business_id, case when phone_result in ('match','mismatch') or address_compared or hc or n > 0 then greatest(0, 100 - coalesce(pen, 0)) end::bigint as consistency_score
from cf left join (select business_id, sum(pen) as pen, count(*) as n from cons group by 1) using (business_id)""", _CF)
def consistency_score(t):
    facts = _facts(t)
    return CN.consistency_score(facts, CN.consistency_findings(facts, now()))


@query("field_comparisons", (B, H), """
select business_id, 'phone' as field, phone_result as result from cf union all select business_id, 'address', address_result from cf
union all select business_id, 'hours', case when hc then case when md > 0 then 'mismatch' else 'match' end else 'not_comparable' end from cf
union all select business_id, 'status', 'mismatch' from cf where k % 9 = 1 and coalesce(business_status, 'OPERATIONAL') = 'OPERATIONAL'""", _CF)
def field_comparisons(t):
    return CN.comparisons(_facts(t)).select("business_id", "field", "result")
