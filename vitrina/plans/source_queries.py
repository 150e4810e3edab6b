"""Sources, discovery and geography: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import hours as H
from ..operators import discovery as DI
from ..operators import official as OF
from ..operators import store as ST
from ..rules import patterns as P
from ..rules.categories import CATEGORIES
from ..rules.platforms import SEARCH_IGNORE_DOMAINS
from ..sources import captures as CA
from ..sources import places as PL
from ..sources import robots as RO
from .fixtures import AS_OF, now
from .registry import query
from .sqltext import quoted, values
from .text_queries import HOST_PARTS, PLATFORM_VALUES, _norm, _squeeze

B = "fx_business"

_COMP = """
pj as (select business_id, body::json as j from fx_place_json),
comp as (select business_id, row_number() over (partition by business_id order by i) as k, json_extract_string(c, '$.longText') as long, json_extract_string(c, '$.shortText') as short, json_extract(c, '$.types') as types
 from (select business_id, unnest(json_extract(j, '$.addressComponents[*]')) as c, generate_subscripts(json_extract(j, '$.addressComponents[*]'), 1) as i from pj)),
pick as (select business_id, arg_min(long, k) filter (where json_contains(types, '"route"')) as route, arg_min(long, k) filter (where json_contains(types, '"street_number"')) as num,
 arg_min(long, k) filter (where json_contains(types, '"locality"')) as loc, arg_min(long, k) filter (where json_contains(types, '"postal_town"')) as town, arg_min(long, k) filter (where json_contains(types, '"administrative_area_level_3"')) as a3,
 arg_min(long, k) filter (where json_contains(types, '"administrative_area_level_1"')) as a1, arg_min(short, k) filter (where json_contains(types, '"country"')) as cc from comp group by 1)
"""


def _json_places(t):
    return t["fx_place_json"].select("business_id", F.from_json("body", PL.COMMERCIAL_SCHEMA).alias("p")).select("business_id", "p.*")


@query("src_places_json", ("fx_place_json",), """
select 'g' || business_id as provider_place_id, json_extract_string(j, '$.displayName.text') as name, route || coalesce(', ' || num, '') as street, coalesce(loc, town, a3) as city, a1 as region, cc as country_code,
 (business_id % 5)::double as rating, 'Bien' as review from pj join pick using (business_id)""", _COMP)
def src_places_json(t):
    p = PL.from_commercial(_json_places(t))
    return p.select("provider_place_id", "name", "street", "city", "region", "country_code", "rating",
                    F.array_join(F.transform("reviews", lambda r: r["text"]), "|").alias("review"))


@query("hours_structured", ("fx_place_json",), """
select business_id, coalesce(json_extract_string(p, '$.open.day')::bigint, 0) as day,
 lpad(coalesce(json_extract_string(p, '$.open.hour'), '0'), 2, '0') || ':' || lpad(coalesce(json_extract_string(p, '$.open.minute'), '0'), 2, '0') as open,
 case when json_extract(p, '$.close') is null then '24:00' else lpad(coalesce(json_extract_string(p, '$.close.hour'), '0'), 2, '0') || ':' || lpad(coalesce(json_extract_string(p, '$.close.minute'), '0'), 2, '0') end as close
from (select business_id, unnest(json_extract(body::json, '$.regularOpeningHours.periods[*]')) as p from fx_place_json)
where json_extract(p, '$.open') is not null and not (json_extract(p, '$.close') is null and json_extract_string(p, '$.open.day') = '0' and json_extract_string(p, '$.open.hour') = '0')
union all select business_id, -1, 'always', 'open' from fx_place_json where business_id % 4 = 0""")
def hours_structured(t):
    p = PL.from_commercial(_json_places(t))
    rows = p.select("business_id", F.inline("opening_hours.periods"))
    always = p.where("opening_hours.always_open").select(
        "business_id", F.lit(-1).alias("day"), F.lit("always").alias("open"), F.lit("open").alias("close"))
    return rows.unionByName(always).withColumn("day", F.col("day").cast("bigint"))


def _tag(k):
    return f"nullif(regexp_extract(tags_text, '(?:^|\\|){k}=([^|]*)', 1), '')"


@query("src_places_osm", ("fx_osm",), f"""
select type || '/' || id as provider_place_id, {_tag('name')} as name,
 concat_ws(', ', case when {_tag('addr:street')} is not null then concat_ws(', ', {_tag('addr:street')}, {_tag('addr:housenumber')}) end, {_tag('addr:postcode')}, {_tag('addr:city')}) as address,
 coalesce({_tag('addr:province')}, {_tag('addr:state')}) as region, trim(split_part(coalesce({_tag('phone')}, {_tag('contact:phone')}, {_tag('contact:mobile')}), ';', 1)) as phone,
 trim(split_part(coalesce({_tag('website')}, {_tag('contact:website')}, {_tag('url')}), ';', 1)) as website, trim(split_part({_tag('email')}, ';', 1)) as email,
 concat_ws(',', 'amenity=' || {_tag('amenity')}, 'shop=' || {_tag('shop')}, 'office=' || {_tag('office')}, 'craft=' || {_tag('craft')}, 'healthcare=' || {_tag('healthcare')}) as types,
 case when {_tag('disused')} = 'yes' or {_tag('disused:shop')} is not null then 'CLOSED_PERMANENTLY' end as business_status, lat
from fx_osm where {_tag('name')} is not null""")
def src_places_osm(t):
    df = t["fx_osm"].withColumn("tags", F.expr("str_to_map(tags_text, '[|]', '=')"))
    p = PL.from_osm(df)
    return p.select("provider_place_id", "name", F.coalesce("formatted_address", F.lit("")).alias("address"), "region",
                    F.col("national_phone").alias("phone"), F.col("provider_website").alias("website"),
                    F.col("provider_email").alias("email"), F.array_join("secondary_categories", ",").alias("types"),
                    "business_status", "lat")


@query("osm_category", ("fx_typed",), "select id, case " + " ".join(
    f"when tag_key = '{k}' and regexp_matches(tag_value, '{p}') then '{c.key}'" for c in CATEGORIES for k, p in c.tag_filters) + " end as category_key from fx_typed")
def osm_category(t):
    tags = F.create_map("tag_key", "tag_value")
    return t["fx_typed"].select("id", DI.tag_category(tags).alias("category_key"))


@query("infer_category", ("fx_typed",), f"""
select id, coalesce(case when hint in ({quoted(c.key for c in CATEGORIES)}) then hint end, (select arg_min(k, place) from (values {values([(i, c.key, ty) for i, c in enumerate(CATEGORIES) for ty in c.place_types])}) as v(place, k, ty) where list_contains(string_split(types, ','), ty))) as category_key from fx_typed""")
def infer_category(t):
    return t["fx_typed"].select("id", DI.infer_category(F.split("types", ","), F.col("hint")).alias("category_key"))


@query("category_request", ("fx_typed",), f"""
select id, case when all_categories or (k = '' and f = '') then '{",".join(c.key for c in CATEGORIES)}' else k end as known, case when all_categories then '' else f end as free_text from (
 select id, all_categories, array_to_string(list_filter(string_split(request, ','), lambda x: x in ({quoted(c.key for c in CATEGORIES)})), ',') as k,
  array_to_string(list_filter(string_split(request, ','), lambda x: x <> '' and x not in ({quoted(c.key for c in CATEGORIES)})), ',') as f from fx_typed)""")
def category_request(t):
    asked = F.filter(F.split("request", ","), lambda x: x != "")
    r = DI.split_request(asked, F.col("all_categories"))
    return t["fx_typed"].select("id", F.array_join(r["known"], ",").alias("known"), F.array_join(r["free_text"], ",").alias("free_text"))


_DAYNUM = "case lower({0}) when 'su' then 0 when 'mo' then 1 when 'tu' then 2 when 'we' then 3 when 'th' then 4 when 'fr' then 5 when 'sa' then 6 end"
_HT = f"""
rules as (select business_id, raw, trim(r) as r, k from (select business_id, raw, unnest(string_split(raw, ';')) as r, generate_subscripts(string_split(raw, ';'), 1) as k from fx_hours_text where raw <> '24/7')
 where trim(r) <> '' and not regexp_matches(trim(r), '(?i)^PH\\b')),
parsed as (select *, case when regexp_matches(r, '(?i)^[A-Za-z,\\- ]+?\\s+(off|closed|\\d\\d:\\d\\d-\\d\\d:\\d\\d(\\s*,\\s*\\d\\d:\\d\\d-\\d\\d:\\d\\d)*)$') then regexp_extract(r, '(?i)^([A-Za-z,\\- ]+?)\\s+(off|closed|\\d)', 1) when regexp_matches(r, '^\\d\\d:\\d\\d-\\d\\d:\\d\\d(\\s*,\\s*\\d\\d:\\d\\d-\\d\\d:\\d\\d)*$') then 'Mo-Su' end as days,
 trim(regexp_extract(r, '(?i)(off|closed|\\d\\d:\\d\\d-.*)$', 1)) as times from rules),
dayparts as (select business_id, k, times, trim(d) as d from (select *, unnest(string_split(days, ',')) as d from parsed where days is not null)),
daynums as (select *, {_DAYNUM.format("split_part(d,'-',1)")} as a, case when contains(d,'-') then {_DAYNUM.format("split_part(d,'-',2)")} else {_DAYNUM.format("d")} end as b from dayparts),
bad as (select business_id from parsed where days is null union select business_id from daynums where a is null or b is null),
expanded as (select distinct business_id, k, times, (a + i) % 7 as day from (select *, unnest(generate_series(0, (b - a + 7) % 7)) as i from daynums where business_id not in (select business_id from bad)))
"""


@query("hours_text_parse", ("fx_hours_text",), """
select business_id, day::bigint as day, split_part(trim(span), '-', 1) as open, split_part(trim(span), '-', 2) as close from (select *, unnest(string_split(times, ',')) as span from expanded where lower(times) not in ('off','closed'))
union all select business_id, -1, 'always', 'open' from fx_hours_text where raw = '24/7'""", _HT)
def hours_text_parse(t):
    p = t["fx_hours_text"].select("business_id", H.text_periods(F.col("raw")).alias("h"))
    rows = p.select("business_id", F.inline("h.periods"))
    always = p.where("h.always_open").select(
        "business_id", F.lit(-1).alias("day"), F.lit("always").alias("open"), F.lit("open").alias("close"))
    return rows.unionByName(always).withColumn("day", F.col("day").cast("bigint"))


@query("business_payload", (B,), """
select business_id, coalesce(case when business_id % 3 = 0 then null else city end, 'Sevilla') as city, coalesce(case when business_id % 4 = 0 then country_code end, 'ES') as country_code, name, rating from fx_business""")
def business_payload(t):
    df = t[B].withColumn("city", F.when(F.col("business_id") % 3 != 0, F.col("city"))).withColumn(
        "country_code", F.when(F.col("business_id") % 4 == 0, F.col("country_code")))
    return ST.business_payload(df, {"city": F.lit("Sevilla"), "country_code": F.lit("ES")}).select(
        "business_id", "city", "country_code", "name", "rating")


@query("business_upsert", (B,), """
select coalesce(c.provider_place_id, i.provider_place_id) as provider_place_id, case when i.provider_place_id is not null then i.name else c.name end as name,
 case when i.provider_place_id is not null then i.rating else c.rating end as rating, c.lead_status, c.provider_place_id is null as is_new
from (select * from fx_business where business_id % 4 <> 0) c full join (select provider_key, provider_place_id, 'Nuevo ' || name as name, case when business_id % 6 = 0 then null else rating end as rating from fx_business where business_id % 2 = 0) i
 on i.provider_key = c.provider_key and i.provider_place_id = c.provider_place_id""")
def business_upsert(t):
    cols = ["provider_key", "provider_place_id", "name", "rating", "lead_status"]
    current = t[B].where("business_id % 4 <> 0").select(*cols)
    incoming = t[B].where("business_id % 2 = 0").select(
        "provider_key", "provider_place_id", F.concat(F.lit("Nuevo "), F.col("name")).alias("name"),
        F.when(F.col("business_id") % 6 != 0, F.col("rating")).alias("rating"))
    return ST.upsert_business(current, incoming).select("provider_place_id", "name", "rating", "lead_status", "is_new")


@query("scan_links", ("fx_scan_business",), "select distinct scan_id, business_id from fx_scan_business")
def scan_links(t):
    links = t["fx_scan_business"]
    return ST.link_scan(links.where("business_id % 2 = 0"), links)


@query("scan_worklist", (B, "fx_scan_business", "fx_job"), f"""
select scan_id, business_id from fx_scan_business s join fx_business b using (business_id)
where not (last_analyzed_at is not null and last_analyzed_at > timestamp '{AS_OF}' - interval 24 hours and not ((scan_id + business_id) % 3 = 0))
 and not exists (select 1 from fx_job j where j.scan_id = s.scan_id and j.business_id = s.business_id and j.status = 'QUEUED')""")
def scan_worklist(t):
    found = t["fx_scan_business"].withColumn("has_reviews", (F.col("scan_id") + F.col("business_id")) % 3 == 0)
    return DI.worklist(found, t[B], t["fx_job"].where("status = 'QUEUED'"), now()).select("scan_id", "business_id")


_HAV = "2 * 6371000 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2)))"


@query("geo_within_radius", (B, "fx_area"), f"select area_id, business_id, round({_HAV}, 3) as distance_m from fx_area a, fx_business b where {_HAV} <= a.radius_m")
def geo_within_radius(t):
    return DI.within_radius(t[B], t["fx_area"]).select("area_id", "business_id", F.round("distance_m", 3).alias("distance_m"))


@query("geo_nearest", (B, "fx_area"), f"""
select area_id, business_id, position from (select area_id, business_id, row_number() over (partition by area_id order by {_HAV}, business_id) as position from fx_area a, fx_business b where {_HAV} <= a.radius_m) where position <= 60""")
def geo_nearest(t):
    return DI.nearest(t[B], t["fx_area"], 60).select("area_id", "business_id", F.col("position").cast("bigint").alias("position"))


@query("tile_circle", ("fx_area",), """
select area_id, i::bigint as i, j::bigint as j, case when n = 0 then radius_m else 5000 end::double as tile_radius_m, round(d, 2) as distance_m from (
 select *, 2 * 6371000 * asin(sqrt(power(sin(radians(i * s) / 2), 2) + cos(radians(lat)) * cos(radians(lat + i * s)) * power(sin(radians(j * s / cos(radians(lat))) / 2), 2))) as d from (
  select *, unnest(generate_series(-n, n)) as j, degrees(5000 * sqrt(2) / 6371000) as s from (select *, unnest(generate_series(-n, n)) as i from (select *, case when radius_m <= 6000 then 0 else ceil(radius_m / (5000 * sqrt(2)))::bigint end as n from fx_area))))
where n = 0 or d <= radius_m + 2500""")
def tile_circle(t):
    return G.tile_circles(t["fx_area"], 5000.0).select(
        "area_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "tile_radius_m",
        F.round("distance_m", 2).alias("distance_m"))


@query("round_robin_sample", ("fx_place_hit",), """
select place_id, query_idx, round::bigint as round from (select *, row_number() over (partition by place_id order by round, query_idx, rank, tile_idx) as rn from (
 select h.*, coalesce(s.start, 0) + (rank - 1) // 20 as round from fx_place_hit h join (
  select query_idx, tile_idx, sum(pages) over (partition by query_idx order by tile_idx rows between unbounded preceding and 1 preceding) as start from (
   select query_idx, tile_idx, (max(rank) + 19) // 20 as pages from fx_place_hit group by 1, 2)) s using (query_idx, tile_idx)))
where rn = 1 order by round, query_idx, rank, tile_idx limit 500""")
def round_robin_sample(t):
    hits = t["fx_place_hit"].withColumn("tile_idx", F.col("tile_idx").cast("bigint"))
    return DI.interleave(hits, 500).select("place_id", "query_idx", "round")


_SITE = f"""
plat(seq, domain, kind, label) as (values {PLATFORM_VALUES}),
hits as (select *, 'www.' || host as full_host from fx_search_hit),
dom as (select h.*, {HOST_PARTS.format(h="full_host")} as domain, (select arg_min(kind, seq) from plat p where p.domain <> 'google.com' and (full_host = p.domain or ends_with(full_host, '.' || p.domain))) as kind from hits h),
elig as (select *, case when readable then case when phone_match then 'phone' when name_coverage >= 0.6 and location_hit then 'name_location' end end as verification
 from (select *, row_number() over (partition by business_id, domain order by rnk) as dr from dom) where dr = 1 and (kind is null or kind = 'FREE_SUBDOMAIN_BUILDER')
 and not exists (select 1 from (values {values([(d,) for d in SEARCH_IGNORE_DOMAINS])}) as g(d) where domain = g.d or ends_with(full_host, '.' || g.d))),
walk as (select *, coalesce(count(*) filter (where verification is null) over w, 0) as failed, coalesce(count(*) filter (where verification is not null) over w, 0) as done from elig
 window w as (partition by business_id order by rnk rows between unbounded preceding and 1 preceding))
"""


@query("official_site", ("fx_search_hit",), """
select business_id, max(case when verification is not null then url end) as url, max(verification) as verification, count(*) filter (where verification is null) as unverified from walk where failed < 3 and done = 0 group by 1""", _SITE)
def official_site(t):
    return DI.official_site(t["fx_search_hit"])


VERIFIED = f"""
plat(seq, domain, kind, label) as (values {PLATFORM_VALUES}),
hp as (select *, regexp_extract(url, '^https://([^/]*)', 1) as host from fx_web_hit where not contains(regexp_extract(url, '^https://([^/]*)', 1), ' ')),
hd as (select *, {HOST_PARTS.format(h="host")} as domain, (select arg_min(kind, seq) from plat p where p.domain <> 'google.com' and (host = p.domain or ends_with(host, '.' || p.domain))) as kind from hp),
h1 as (select *, row_number() over (partition by business_id, domain order by rnk, url) as dr from hd),
play as (select *, row_number() over (partition by business_id order by rnk) as position, 'https://' || host || '/' as home from h1 where dr = 1 and (kind is null or kind = 'FREE_SUBDOMAIN_BUILDER')
 and not exists (select 1 from (values {values([(d,) for d in SEARCH_IGNORE_DOMAINS])}) as g(d) where domain = g.d or ends_with(host, '.' || g.d)) qualify position <= 3),
cap as (select * from fx_home_capture qualify row_number() over (partition by requested_url order by attempt desc, url desc) = 1),
pgs as (select *, case when error_code is not null then error_code when status >= 400 or not contains(lower(content_type), 'text/html') then 'HTTP ' || status end as unread,
 regexp_extract(html, '<title>(.*?)</title>', 1) || ' ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) || ' ' || {_squeeze("regexp_replace(regexp_extract(html, '<body>(.*)</body>', 1), '<[^>]*>', ' ', 'g')")} as hay,
 list_transform(list_concat(regexp_extract_all(html, 'tel:([^"]*)"', 1), regexp_extract_all(html, 'Tel. ([0-9 ]*)', 1)), lambda x: '+34' || regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^34([0-9]{{9}})$', '\\1')) as phones from cap),
judge as (select p.business_id, p.position, p.home, g.url as final_url, g.unread, g.requested_url is not null as fetched,
 coalesce(list_contains(g.phones, '+34' || b.national_phone), false) as by_phone,
 len(list_filter(toks, lambda x: contains({_norm("g.hay")}, x))) / len(toks) as cover,
 contains({_norm("g.hay")}, {_norm("b.city")}) or coalesce(contains(g.hay, b.postal_code), false) as located
 from play p join (select *, list_filter(string_split(regexp_replace({_norm("name")}, '[^a-z0-9ñ ]', ' ', 'g'), ' '), lambda x: length(x) >= 3 and x not in ({quoted(P.NAME_STOPWORDS)})) as toks from fx_business) b using (business_id)
 left join pgs g on g.requested_url = p.home),
ver as (select *, fetched and unread is null as readable, case when fetched and unread is null then case when by_phone then 'phone' when cover >= 0.6 and located then 'name_location' end end as verification,
 case when fetched and unread is null then 'Coincidencia insuficiente (nombre ' || floor(cover * 100 + 0.5)::int || '%, ubicación ' || case when located then 'sí' else 'no' end || ')' else 'No verificable (' || coalesce(unread, 'error') || ')' end as reason,
 case when fetched and unread is null then final_url else home end as url from judge),
walk as (select *, coalesce(bool_or(verification is not null) over (partition by business_id order by position rows between unbounded preceding and 1 preceding), false) as done from ver),
found as (select b.business_id, b.provider_key, b.provider_website, r.url, r.verification, coalesce(r.candidates, '') as candidates from fx_business b left join (
 select business_id, max(case when verification is not null then url end) as url, max(verification) as verification,
  string_agg(url || ' (' || reason || ')', '; ' order by position) filter (where verification is null) as candidates from walk where not done group by 1) r using (business_id))
"""


def _search(t):
    business = t[B].withColumn("international_phone", F.lit(None).cast("string"))
    return OF.find(business, t["fx_web_hit"], t["fx_home_capture"])


@query("official_site_verified", (B, "fx_web_hit", "fx_home_capture"), "select business_id, url, verification, candidates from found", VERIFIED)
def official_site_verified(t):
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["url"], F.lit(" ("), c["reason"], F.lit(")"))), "; ")
    return _search(t).select("business_id", "url", "verification", shown.alias("candidates"))


@query("official_site_findings", (B, "fx_web_hit", "fx_home_capture", "fx_finding_raw"), """
select business_id, code, 'INFO' as severity, confidence, title, description from fx_finding_raw where business_id in (select business_id from found where url is not null)
union all select business_id, 'GOOGLE_LISTING_MISSING_WEBSITE', 'MEDIUM', case verification when 'phone' then 'HIGH' else 'MEDIUM' end,
 'La ficha de ' || case provider_key when 'google_places' then 'Google' else 'OpenStreetMap' end || ' no enlaza la web del negocio',
 'La web se ha encontrado mediante buscador y se ha verificado por ' || case verification when 'phone' then 'coincidencia de teléfono' else 'coincidencia de nombre y ubicación' end || '.' from found where url is not null""", VERIFIED)
def official_site_findings(t):
    rows = OF.found_findings(_search(t), t[B], t["fx_finding_raw"])
    return rows.select("business_id", "code", "severity", "confidence", "title", "description")


@query("official_site_notes", (B, "fx_web_hit", "fx_home_capture"), f"""
select business_id, '{OF.NOTE}' || candidates as note from found where url is null and candidates <> ''""", VERIFIED)
def official_site_notes(t):
    return OF.search_notes(_search(t))


@query("robots_rules", ("fx_robots",), """
select site_id, name as kind, seq, value from mark where value <> '' and (name = 'sitemap' or (name in ('allow','disallow') and grp > 0 and case when anyspec then spec else gen end))""", """
ln as (select site_id, trim(regexp_replace(l, '#.*$', ''), E' \\t\\r') as l, i - 1 as seq from (select site_id, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1) as i from fx_robots)),
kv as (select site_id, seq, lower(trim(split_part(l, ':', 1))) as name, trim(substr(l, strpos(l, ':') + 1)) as value from ln where contains(l, ':')),
og as (select *, case when name = 'user-agent' and coalesce(lag(name) over (partition by site_id order by seq), '') <> 'user-agent' then 1 else 0 end as op from kv),
gr as (select *, sum(op) over (partition by site_id order by seq) as grp from og),
sp as (select *, bool_or(name = 'user-agent' and value <> '*' and contains('sitecheck', lower(value))) over (partition by site_id, grp) as spec, bool_or(name = 'user-agent' and value = '*') over (partition by site_id, grp) as gen from gr),
mark as (select *, bool_or(spec) over (partition by site_id) as anyspec from sp)""")
def robots_rules(t):
    return RO.parse_robots(t["fx_robots"])


_ROBOTS_CTE = """
ln as (select site_id, path, trim(regexp_replace(l, '#.*$', ''), E' \\t\\r') as l, i - 1 as seq from (select site_id, path, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1) as i from fx_robots)),
kv as (select site_id, path, seq, lower(trim(split_part(l, ':', 1))) as name, trim(substr(l, strpos(l, ':') + 1)) as value from ln where contains(l, ':')),
og as (select *, case when name = 'user-agent' and coalesce(lag(name) over (partition by site_id order by seq), '') <> 'user-agent' then 1 else 0 end as op from kv),
gr as (select *, sum(op) over (partition by site_id order by seq) as grp from og),
sp as (select *, bool_or(name = 'user-agent' and value <> '*' and contains('sitecheck', lower(value))) over (partition by site_id, grp) as spec, bool_or(name = 'user-agent' and value = '*') over (partition by site_id, grp) as gen from gr),
mark as (select *, bool_or(spec) over (partition by site_id) as anyspec from sp),
hit as (select site_id, arg_max(name = 'allow', length(value) * 2 + (name = 'allow')::int) as ok from mark where value <> '' and name in ('allow','disallow') and grp > 0 and case when anyspec then spec else gen end
 and regexp_matches(path, '^' || replace(regexp_replace(regexp_replace(value, '([.+?^{}()|$])', '\\\\\\1', 'g'), '\\\\\\$$', '$'), '*', '.*')) group by 1)"""


@query("robots_allowed", ("fx_robots",), "select f.site_id, f.path, coalesce(ok, true) as allowed from fx_robots f left join hit using (site_id)", _ROBOTS_CTE)
def robots_allowed(t):
    return RO.allowed(t["fx_robots"].select("site_id", "path"), RO.parse_robots(t["fx_robots"]))


@query("sitemap_lastmod", (), f"""
select site_id, strftime(arg_min(newest, seq), '%Y-%m-%d') as lastmod from (
 select page_id % 97 as site_id, page_id as seq, max(d) filter (where d < timestamp '{AS_OF}' + interval 1 day) as newest
 from (select page_id, unnest([make_timestamp(2019 + page_id % 6, 1 + page_id % 12, 5, 0, 0, 0.0), make_timestamp(2018 + page_id % 5, 3, 1 + page_id % 28, 0, 0, 0.0)]) as d from pages where page_id % 4 <> 0 and page_id % 5 <> 0) group by 1, 2) where newest is not null group by 1""")
def sitemap_lastmod(t):
    pid = F.col("page_id")
    xml = F.concat(
        F.when(pid % 5 == 0, "<html>").otherwise("<?xml version='1.0'?><URLSET>"),
        F.lit("<url><lastmod> "), (2019 + pid % 6).cast("string"), F.lit("-"), F.lpad((1 + pid % 12).cast("string"), 2, "0"),
        F.lit("-05T00:00:00Z </lastmod></url><lastmod>bad</lastmod><LASTMOD>"), (2018 + pid % 5).cast("string"), F.lit("-03-"),
        F.lpad((1 + pid % 28).cast("string"), 2, "0"), F.lit("</LASTMOD>"))
    maps = t["pages"].select((pid % 97).alias("site_id"), pid.alias("seq"), F.when(pid % 4 == 0, 404).otherwise(200).alias("status"), xml.alias("xml"))
    # a file whose dates are all in the future counts as undated here, as the SQL drops it before choosing the first file
    dated = RO.sitemap_lastmod(maps.withColumn("site_id", F.struct("site_id", "seq")), now())
    return dated.select("site_id.site_id", "site_id.seq", "lastmod").groupBy("site_id").agg(
        F.date_format(F.min_by("lastmod", "seq"), "yyyy-MM-dd").alias("lastmod"))


@query("reviews_clean", ("fx_review",), "select review_id, text from fx_review where length(trim(text)) > 0 and review_id % 7 <> 0")
def reviews_clean(t):
    df = t["fx_review"].withColumn("text", F.when(F.col("review_id") % 7 == 0, "  ").otherwise(F.col("text")))
    return PL.clean_reviews(df).select("review_id", "text")


@query("body_decode", (), """
select doc_id, case when not regexp_matches(text, '[^\\x{00}-\\x{ff}]') then 'iso-8859-1' when doc_id % 3 = 1 then 'utf8' else 'utf-8' end as charset, length('Menú <p>' || text) as n, 'Menú' as head from documents""")
def body_decode(t):
    latin = ~F.col("text").rlike(r"[^\x00-\xff]")
    text = F.concat(F.lit("Menú <p>"), F.col("text"))
    rows = t["documents"].select(
        "doc_id",
        F.when(latin, "text/html; charset=ISO-8859-1").when(F.col("doc_id") % 3 == 1, "text/html;CHARSET= utf8 ; x").otherwise("text/html").alias("ct"),
        F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8")).alias("body"))
    out = CA.decode_bodies(rows, F.col("ct"))
    return out.select("doc_id", "charset", F.length("html").alias("n"), F.substring("html", 1, 4).alias("head"))
