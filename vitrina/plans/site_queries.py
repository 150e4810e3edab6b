"""Website audit: queries with their SQL. Each captured page stands for one site here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts as CO
from ..operators import extraction as EX
from ..operators import findings as FI
from ..operators import site as SI
from ..rules import patterns as P
from ..rules.categories import CATEGORIES
from ..rules.platforms import PARKING_HOSTS
from ..rules.regex import ansi
from .page_queries import PAGES, _count, _feats, _meta
from .registry import query
from .sqltext import quoted
from .stages import staged
from .text_queries import _URLS, HOST_PARTS, PLATFORM_VALUES

PAGE, CAP, PROBE = "fx_page", "fx_capture", "fx_probe"
KEY = "page_id"

_OUT = f"""
a1 as (select f.*, i.error_code as ie, i.status as ist, i.page_id is not null as ih, s.error_code as se, s.status as sst, s.page_id is not null as sh, o.error_code as oe, o.status as ost, o.url as ourl, o.page_id is not null as oh, w.error_code as we, w.status as wst, w.page_id is not null as wh
 from (select * from fx_capture where purpose='first') f left join (select * from fx_capture where purpose='insecure') i using (page_id) left join (select * from fx_capture where purpose='slow') s using (page_id)
 left join (select * from fx_capture where purpose='other_protocol') o using (page_id) left join (select * from fx_capture where purpose='www') w using (page_id)),
a2 as (select *, case when error_code = 'TLS_ERROR' and ih then ie when error_code = 'TIMEOUT' and sh then se else error_code end as e2 from a1),
a3 as (select *, coalesce(e2 in ('CONNECTION_REFUSED','TIMEOUT','CONNECTION_RESET','HOST_UNREACHABLE','TLS_ERROR') and oh and oe is null, false) as use_o, coalesce(e2 = 'DNS_NOT_FOUND' and wh and we is null, false) as use_w from a2),
a4 as (select *, case when use_o or use_w then null else e2 end as err, use_o and starts_with(requested_url, 'https:') as https_dead, case when use_o then ourl else url end as final_url from a3),
oc as (select *, case when error_code = 'SSRF_BLOCKED' then 'unverifiable' when err in ({quoted(P.UNREACHABLE_REASON)}) then 'down' when err is not null then 'unverifiable'
  when status in (403,503,429) and regexp_matches(html, {ansi(P.CHALLENGE)}) then 'unverifiable' when status in (401,403,407,429,451) then 'unverifiable' when status >= 500 or status in (404,410) then 'down'
  when status < 200 or status >= 400 then 'unverifiable' when html = '' then 'down' else 'ok' end as outcome,
  case when error_code = 'SSRF_BLOCKED' then 'SSRF_BLOCKED' when err is not null then err when status in (401,403,407,429,451) or status >= 400 then 'HTTP_' || status when html = '' then 'EMPTY' end as code from a4)
"""


def _outcomes(t):
    return SI.capture_outcome(t[CAP], KEY)


@query("capture_outcome", (CAP,), "select page_id, outcome, code, https_dead from oc", _OUT)
def capture_outcome(t):
    return _outcomes(t).select(KEY, "outcome", "code", "https_dead")


_GATE = _OUT + f""",
plat(seq, domain, kind, label) as (values {PLATFORM_VALUES}),
gt0 as (select *, regexp_extract(requested_url, '://([^/?#]*)', 1) as h1, regexp_extract(final_url, '://([^/?#]*)', 1) as h2 from oc),
gt1 as (select *, (select arg_min(kind, seq) from plat where domain <> 'google.com' and (h2 = domain or ends_with(h2, '.' || domain))) as fk, {HOST_PARTS.format(h='h1')} <> {HOST_PARTS.format(h='h2')} as other_domain from gt0),
gt as (select *, case when outcome <> 'ok' then outcome when fk not in ('FREE_SUBDOMAIN_BUILDER','DISCONTINUED_BUILDER') then 'redirect_third_party' when {' or '.join(f"ends_with(h2, '{h}')" for h in PARKING_HOSTS)} then 'parking_host'
  when not contains(lower(content_type), 'text/html') then 'not_html' when not robots_allowed then 'robots' end as gate from gt1)
"""


def _gates(t):
    return SI.gates(_outcomes(t), KEY)


@query("site_gates", (CAP,), "select page_id, gate from gt", _GATE)
def site_gates(t):
    return _gates(t).select(KEY, "gate")


@query("url_gates", ("fx_url",), f"""
select url_id, case when not ok then 'url_invalid' when kind not in ('FREE_SUBDOMAIN_BUILDER','DISCONTINUED_BUILDER') then 'third_party' when kind = 'DISCONTINUED_BUILDER' then 'discontinued' end as gate from u4 left join cls using (url_id)""",
       _URLS)
def url_gates(t):
    ok = t["fx_url"].select(
        "url_id", F.struct(F.lit(1).alias("attempt"), F.col("url").alias("requested_url"), F.lit("https://own.example/").alias("url"),
                           F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(True).alias("robots_allowed")).alias("res"),
        F.lit("ok").alias("outcome"), F.col("url").alias("requested_url"))
    return SI.gates(ok, "url_id").select("url_id", "gate")


@query("finding_rules_network", (CAP,), """
select page_id, code, severity, confidence from (
 select page_id, 'WEBSITE_UNREACHABLE' as code, 'CRITICAL' as severity, case when code = 'TIMEOUT' then 'MEDIUM' else 'HIGH' end as confidence from gt where outcome = 'down' and not starts_with(code, 'HTTP') and code <> 'EMPTY'
 union all select page_id, 'WEBSITE_HTTP_ERROR', 'CRITICAL', 'HIGH' from gt where outcome = 'down' and starts_with(code, 'HTTP')
 union all select page_id, 'EMPTY_RESPONSE', 'CRITICAL', 'HIGH' from gt where outcome = 'down' and code = 'EMPTY'
 union all select page_id, 'HTTPS_NOT_WORKING', 'HIGH', 'HIGH' from gt where https_dead
 union all select page_id, case when contains(error_detail, 'LEAF_SIGNATURE') then 'TLS_CHAIN_INCOMPLETE' when contains(error_detail, 'EXPIRED') then 'TLS_CERT_EXPIRED' when contains(error_detail, 'SELF_SIGNED') then 'TLS_CERT_SELF_SIGNED' when contains(error_detail, 'ALTNAME') then 'TLS_CERT_HOSTNAME_MISMATCH' else 'TLS_ERROR' end,
  case when contains(error_detail, 'LEAF_SIGNATURE') then 'MEDIUM' when contains(error_detail, 'handshake') then 'HIGH' else 'CRITICAL' end, 'HIGH' from gt where error_code = 'TLS_ERROR'
 union all select page_id, 'DOMAIN_REDIRECTS_TO_THIRD_PARTY', 'HIGH', 'HIGH' from gt where gate = 'redirect_third_party'
 union all select page_id, 'DOMAIN_PARKED', 'CRITICAL', 'HIGH' from gt where gate = 'parking_host'
 union all select page_id, 'REDIRECTS_TO_OTHER_DOMAIN', 'LOW', 'MEDIUM' from gt where other_domain and coalesce(gate, 'not_html') in ('not_html','robots')
 union all select page_id, 'ROBOTS_BLOCKS_ANALYSIS', 'INFO', 'HIGH' from gt where gate = 'robots')""", _GATE)
def finding_rules_network(t):
    return FI.emit(_gates(t), SI.network_rules(), [KEY]).select(KEY, "code", "severity", "confidence")


@query("broken_links", (PROBE,), """
select page_id, target_url, target_kind from fx_probe where error in ('DNS_NOT_FOUND','CONNECTION_REFUSED') or status in (404, 410) or (status >= 500 and status <> 503)""")
def broken_links(t):
    return t[PROBE].where(SI.is_broken()).select(KEY, "target_url", "target_kind")


_BROKEN = "coalesce(error in ('DNS_NOT_FOUND','CONNECTION_REFUSED'), false) or coalesce(status in (404, 410) or (status >= 500 and status <> 503), false)"
_PF = f"""
pf as (select page_id, count(*) filter (where target_kind='link' and ({_BROKEN})) as broken_links, count(*) filter (where target_kind='image' and ({_BROKEN})) as broken_images, count(*) filter (where target_kind='resource' and ({_BROKEN})) as broken_resources,
 count(*) filter (where target_kind='resource' and is_script and ({_BROKEN})) as broken_scripts, count(*) filter (where target_kind='resource' and is_script) as own_scripts, count(*) filter (where target_kind='domain' and error='DNS_NOT_FOUND') as dead_domains,
 count(*) filter (where target_kind='image' and bytes > 1000000) as heavy_images, sum(case when target_kind='image' then bytes else 0 end)::bigint as image_bytes, sum(case when target_kind='resource' then bytes else 0 end)::bigint as resource_bytes, count(*) filter (where target_kind='link') as links_checked
 from fx_probe group by 1)"""


@query("resource_stats", (PROBE,), "select * from pf", _PF)
def resource_stats(t):
    return SI.probe_facts(t[PROBE], KEY)


def _extraction(t):
    def build():
        return EX.site_extraction(_feats(t), KEY, F.lit("ES"), 2024)
    return staged(t, "page_extraction", build)


def _needs(t):
    pick = lambda i: F.create_map(*[F.lit(x) for j, c in enumerate(CATEGORIES) for x in (j, c[i])])[(F.col(KEY) % 12).cast("int")]
    return t["pages"].select(KEY, pick(7).alias("needs_booking"), pick(8).alias("needs_menu"))


def _rows(t):
    def build():
        gated = _gates(t)
        return SI.site_rows(gated, _feats(t), _extraction(t), t[PROBE], _needs(t), KEY)
    return staged(t, "site_rows", build)


# facts known from how the pages were derived
_KNOW = f""",
kn as (select br.page_id, br.url, br.text, page_id % 29 = 3 as js, page_id % 7 as h, page_id % 11 as b, lower({_meta('robots')}) as robots, {_meta('viewport')} as viewport, {_count("= 'h1'")} as h1n,
  len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as words, regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title\\s*>', 1) as title0 from br)"""
_ALL = _GATE + "," + PAGES + _KNOW + "," + _PF + f""",
tt as (select page_id, replace(replace(title0, '&amp;', '&'), '&middot;', '·') as title from kn),
ph as (select kn.page_id, case when regexp_matches(s, {ansi(P.PARKED)}) and w < 400 then 'PARKED' when regexp_matches(s, {ansi(P.UNDER_CONSTRUCTION)}) and w < 250 then 'UC' when regexp_matches(s, {ansi(P.PLACEHOLDER)}) then 'PH' end as placeholder
  from (select page_id, text || ' ' || title as s, len(regexp_extract_all(text || ' ' || title, '[\\p{{L}}\\p{{N}}]+')) as w from kn join tt using (page_id)) kn),
op0 as (select gt.*, kn.* exclude (page_id, url), t.title, p.placeholder, pf.* exclude (page_id), coalesce(gate, case when p.placeholder = 'PARKED' then 'parked_text' when js and own_scripts > 0 and broken_scripts = own_scripts then 'js_broken' end) as gate2
 from gt join kn using (page_id) join tt t using (page_id) join ph p using (page_id) left join pf using (page_id)),
op as (select * from op0 where gate2 is null)
"""
_USES = (CAP, PAGE, PROBE)


def _family(name, sql):
    @query(f"finding_rules_{name}", _USES, sql, _ALL)
    def run(t):
        return SI.audit_findings(_rows(t), KEY, [name]).select(KEY, "code", "severity", "confidence")


def _u(*rows):
    return " union all ".join(f"select page_id, '{c}' as code, {s} as severity, '{cf}' as confidence from op where {w}" for c, s, cf, w in rows)


_M, _LOW, _HIGH, _CRIT = "'MEDIUM'", "'LOW'", "'HIGH'", "'CRITICAL'"
_family("security", _u(
    ("HTTPS_NOT_ENFORCED", _M, "HIGH", "starts_with(final_url,'http:') and https_available"),
    ("NO_HTTPS", _HIGH, "HIGH", "starts_with(final_url,'http:') and not https_available and not https_dead"),
    ("HTTP_NOT_REDIRECTED", _LOW, "HIGH", "starts_with(final_url,'https:') and http_redirects_https = false"),
    ("TLS_CERT_EXPIRING", _M, "HIGH", "starts_with(final_url,'https:') and tls_days_left < 21"),
    ("EXCESSIVE_REDIRECTS", _LOW, "HIGH", "redirects > 3")))
_family("performance", _u(
    ("SLOW_RESPONSE", "case when total_ms > 6000 then 'HIGH' else 'MEDIUM' end", "HIGH", "total_ms > 3000"),
    ("HEAVY_IMAGES", "case when heavy_images >= 3 then 'MEDIUM' else 'LOW' end", "HIGH", "heavy_images > 0"),
    ("BROKEN_INTERNAL_LINKS", "case when broken_links >= 3 then 'HIGH' else 'MEDIUM' end", "HIGH", "broken_links > 0"),
    ("BROKEN_IMAGES", _M, "HIGH", "broken_images > 0"), ("MISSING_RESOURCES", _M, "HIGH", "broken_resources > 0"),
    ("DEAD_EXTERNAL_DOMAINS", _M, "MEDIUM", "dead_domains > 0"), ("NO_FAVICON", _LOW, "HIGH", "not favicon_ok")))
_family("seo", _u(
    ("MISSING_TITLE", _M, "HIGH", "title = ''"), ("GENERIC_TITLE", _LOW, "HIGH", f"title <> '' and (length(title) < 8 or regexp_matches(title, {ansi(P.GENERIC_TITLE)}))"),
    ("LONG_TITLE", _LOW, "HIGH", "length(title) > 70"), ("MISSING_META_DESCRIPTION", _LOW, "HIGH", "js or h <> 1"), ("NO_H1", _LOW, "HIGH", "h1n = 0"),
    ("MISSING_LANG", _LOW, "HIGH", "js"), ("NOINDEX", _HIGH, "HIGH", "contains(robots, 'noindex')"), ("NO_LOCAL_SCHEMA", _LOW, "HIGH", "js or h not in (4, 5)")))
_family("mobile", _u(
    ("NO_VIEWPORT", _HIGH, "HIGH", "coalesce(viewport, '') = ''"), ("FIXED_WIDTH_VIEWPORT", _HIGH, "HIGH", "viewport = 'width=1024'"),
    ("ZOOM_DISABLED", _LOW, "HIGH", "contains(viewport, 'user-scalable=no') or contains(viewport, 'maximum-scale=1')"),
    ("HORIZONTAL_OVERFLOW", _HIGH, "HIGH", "horizontal_overflow"), ("TABLE_LAYOUT", _M, "MEDIUM", "not js and b = 8"),
    ("USES_FLASH", _HIGH, "HIGH", "not js and b = 8"), ("DEPRECATED_HTML", _LOW, "HIGH", "not js and b = 8")))
_family("a11y", _u(("ACCESSIBILITY_BASIC", "case when b = 4 then 'MEDIUM' else 'LOW' end", "HIGH", "not js and b in (3, 4, 9)")))
_family("tech", _u(
    ("OUTDATED_CMS", _M, "MEDIUM", "not js and h in (2, 3)"), ("OUTDATED_JQUERY", _LOW, "MEDIUM", "not js and h = 2"),
    ("MIXED_CONTENT", _M, "HIGH", "not js and starts_with(url, 'https') and (h = 4 or b = 4)"),
    ("CONSOLE_ERRORS", "case when console_errors >= 5 then 'MEDIUM' else 'LOW' end", "HIGH", "console_errors > 0"),
    ("UNDER_CONSTRUCTION", _CRIT, "HIGH", "placeholder = 'UC'"), ("PLACEHOLDER_CONTENT", _HIGH, "HIGH", "placeholder = 'PH'")))


@query("finding_rules_content", _USES)
def finding_rules_content(t):
    return SI.audit_findings(_rows(t), KEY, ["content"]).select(KEY, "code", "severity", "confidence")


@query("js_app_broken", _USES, "select page_id from op0 where gate2 = 'js_broken'", _ALL)
def js_app_broken(t):
    return _rows(t).where("gate = 'js_broken'").select(KEY)


@query("site_volume", (PAGE,), """
select page_id, words::bigint as total_words, case when not js and b = 4 then 3 else 0 end as stock_images, (select count(distinct href) from lk where lk.page_id = kn.page_id and internal) as internal_links from kn""", PAGES + _KNOW)
def site_volume(t):
    own = F.size(F.array_distinct(F.transform(F.filter("links", lambda x: x["internal"]), lambda x: x["href"]))).cast("bigint")
    return _feats(t).select(KEY, own.alias("internal_links")).join(
        EX.site_totals(_feats(t), KEY).select(KEY, "total_words", F.col("stock_images").cast("bigint").alias("stock_images")), KEY)


@query("site_status", _USES)
def site_status(t):
    rows = _rows(t)
    return SI.site_status(rows, FI.dedupe(SI.audit_findings(rows, KEY), KEY), KEY)


@query("site_status_gated", _USES, """
select page_id, gate2 as gate, case when gate2 = 'redirect_third_party' then 'SIN_WEB' when gate2 in ('down','parking_host','parked_text','js_broken') then 'WEB_CAIDA' else 'WEB_NO_VERIFICABLE' end as website_status,
 case when gate2 in ('down','parking_host','parked_text','js_broken') then 0 end::bigint as technical_score, gate2 in ('down','redirect_third_party','parking_host','parked_text','js_broken') as analysis_complete from op0 where gate2 is not null""", _ALL)
def site_status_gated(t):
    return site_status(t).where("gate is not null").drop("fetch_reason")


def _site_pages(t):
    def build():
        return EX.site_extraction(_feats(t), "business_id", F.lit("ES"), 2024)
    return staged(t, "site_extraction", build)


@query("site_extraction", (PAGE,), """
select business_id, count(*) as pages, count(distinct case when not js and page_id % 11 = 1 then '+34954123456' when not js and page_id % 11 = 2 then '+34954123456' end) as phones,
 bool_or(not js and page_id % 11 = 1) as clickable, bool_or(not js and page_id % 11 = 2) as has_shop_email, count(*) filter (where not js and page_id % 11 = 5) > 0 as has_map
from (select *, page_id % 29 = 3 as js from fx_page) group by 1""")
def site_extraction(t):
    known = F.filter("phones", lambda p: p["e164"] == "+34954123456")
    return _site_pages(t).select(
        "business_id", "pages", F.size(known).cast("bigint").alias("phones"),
        F.coalesce(F.exists(known, lambda p: p["clickable"]), F.lit(False)).alias("clickable"),
        F.exists("emails", lambda e: e["value"] == "hola@tienda.es").alias("has_shop_email"), "has_map")


@query("contacts_site", (PAGE,))
def contacts_site(t):
    return CO.merge(CO.from_site(_site_pages(t))).select("business_id", "type", "value", "confidence", "seq")


@query("contacts_listing", ("fx_business",), f"""
select business_id, 'PHONE' as type, '+34' || national_phone as value, 'HIGH' as confidence from fx_business where national_phone is not null
union all select business_id, 'EMAIL', 'info' || business_id || '@bar.es', 'HIGH' from fx_business where business_id % 2 = 0
union all select business_id, case when business_id % 3 = 1 then 'INSTAGRAM' else 'FACEBOOK' end, case when business_id % 3 = 1 then 'https://www.instagram.com/bar' else 'https://www.facebook.com/bar' end, 'HIGH' from fx_business where business_id % 3 > 0
union all select business_id, case business_id % 8 when 1 then 'FACEBOOK' when 7 then 'INSTAGRAM' else 'OTHER' end, replace(provider_website, 'Instagram', 'instagram'), 'HIGH' from fx_business where business_id % 8 in (1, 3, 5, 7)""")
def contacts_listing(t):
    k = F.col("business_id")
    b = t["fx_business"].withColumns({
        "international_phone": F.lit(None).cast("string"), "website_uri": F.col("provider_website"),
        "email": F.when(k % 2 == 0, F.concat(F.lit("INFO"), k.cast("string"), F.lit("@bar.es"))),
        "socials": F.when(k % 3 == 1, F.create_map(F.lit("instagram"), F.lit("@bar"))).when(k % 3 == 2, F.create_map(F.lit("facebook"), F.lit("bar")))})
    return CO.merge(CO.from_listing(b)).select("business_id", "type", "value", "confidence")

