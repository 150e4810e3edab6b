"""HTML pages: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as HT
from ..functions import text as T
from ..functions import url as U
from ..operators import links as LI
from ..operators import pages as PG
from ..rules import patterns as P
from ..rules.platforms import BOOKING_HOSTS
from ..rules.regex import ansi
from ..sources import robots as RO
from .registry import query
from .stages import staged
from .sqltext import values
from .text_queries import HOST_PARTS, PLATFORM_VALUES, _squeeze, _trim

PAGE = "fx_page"
A = """((?:[^''">]|"[^"]*"|''[^'']*'')*)"""
HIDDEN = ["script", "style", "noscript", "svg", "template", "iframe"]
_ENT = [("&iacute;", "í"), ("&uacute;", "ú"), ("&oacute;", "ó"), ("&eacute;", "é"), ("&copy;", "©"), ("&#8211;", "–"), ("&nbsp;", "\u00a0"), ("&middot;", "·"),
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]


def _unesc(x):
    for a, b in _ENT:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _hidden(x):
    for n in HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{n}\\b{A}>.*?(</{n}\\s*>|$)', '', 'g')"
    return x


_BLOCK = "(?i)</(?:p|div|li|td|th|a|h1|h2|h3|h4|h5|h6|section|footer|header|address|dd|dt)\\s*>|<(?:br|p|li|td|th|dd|dt)\\b[^>]*>"
_TAGRE = f"</?[a-zA-Z]{A}>"


def _attr(tag, name):
    return f"""case when regexp_matches({tag}, '(?i)[\\s"''/]{name}[\\s=/>]') then regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1) || regexp_extract({tag}, '(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 3) end"""


PAGES = f"""
cl as (select page_id, business_id, seq, url, regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g') as clean, regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') as host, regexp_replace(url, '[?#].*$', '') as nopar from fx_page),
br as (select *, regexp_replace(regexp_replace(clean, '(?is)(<script\\b{A}>).*?</script\\s*>', '\\1</script>', 'g'), '(?is)(<style\\b{A}>).*?</style\\s*>', '\\1</style>', 'g') as bare,
 {_squeeze(_unesc(f"regexp_replace(regexp_replace({_hidden("regexp_replace(regexp_replace(clean, '(?is)^.*?<body\\b[^>]*>', ''), '(?is)</body\\s*>.*$', '')")}, '{_BLOCK}', ' ', 'g'), '{_TAGRE}', '', 'g')"))} as text from cl),
tg as (select page_id, k, t as raw, lower(regexp_extract(t, '^<([a-zA-Z][^\\s/>]*)', 1)) as name from (select page_id, unnest(regexp_extract_all(bare, '{_TAGRE}')) as t, generate_subscripts(regexp_extract_all(bare, '{_TAGRE}'), 1) as k from br) where not starts_with(t, '</')),
an0 as (select page_id, business_id, seq, url, host, k, trim({_attr("'<a' || h || '>'", 'href')}) as raw, {_squeeze(_unesc(f"regexp_replace(b, '{_TAGRE}', '', 'g')"))} as text from (
 select page_id, business_id, seq, url, host, unnest(regexp_extract_all(bare, '(?is)<a\\b{A}>(.*?)</a\\s*>', 1)) as h, unnest(regexp_extract_all(bare, '(?is)<a\\b{A}>(.*?)</a\\s*>', 2)) as b, generate_subscripts(regexp_extract_all(bare, '(?is)<a\\b{A}>(.*?)</a\\s*>', 1), 1) as k from br)),
an as (select *, case when raw is null or raw = '' or starts_with(raw, '#') or regexp_matches(raw, '(?i)^(javascript|data|tel|mailto):') then null else
  case when regexp_matches(raw, '^https?:') then raw when starts_with(raw, '//') then split_part(url, ':', 1) || ':' || raw when starts_with(raw, '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') || raw else regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || raw end end as href0 from an0),
lk as (select *, regexp_replace(regexp_extract(href, '://([^/?#]*)', 1), '^www\\.', '') = host as internal, regexp_extract(href, '://([^/?#]*)', 1) as lhost, regexp_extract(href, '://[^/?#]*([^?#]*)', 1) as path from (
 select *, array_to_string(list_transform(string_split(href0, ''), lambda ch: case when ch = ' ' then '%20' when regexp_matches(ch, '[^\\x21-\\x7e]') then url_encode(ch) else ch end), '') as href from an where href0 is not null))
"""


def _feats(t, *columns):
    return staged(t, "page_features", lambda: PG.features(t[PAGE]), *columns)


def _count(name, cond="true"):
    return f"(select count(*) from tg where tg.page_id = br.page_id and name {name} and {cond})"


def _meta(name):
    return f"(select arg_min({_attr('raw', 'content')}, k) from tg where tg.page_id = br.page_id and name = 'meta' and lower({_attr('raw', 'name')}) = '{name}')"


@query("page_features", (PAGE,), f"""
select page_id, nullif({_squeeze(_unesc("regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"))}, '') as title,
 nullif({_trim(_unesc(_meta('description')))}, '') as description, {_trim(_meta('viewport'))} as viewport, {_meta('generator')} as generator, lower({_meta('robots')}) as robots,
 (select nullif(any_value({_attr('raw', 'lang')}), '') from tg where tg.page_id = br.page_id and name = 'html') as lang,
 {_count("= 'h1'")} as h1_count, {_count("= 'img'", '(' + _attr('raw', 'src') + ' is not null or ' + _attr('raw', 'data-src') + ' is not null)')} as images,
 {_count("= 'script'", _attr('raw', 'src') + ' is not null')} as scripts, {_count("= 'script'", _attr('raw', 'src') + ' is null')} as inline_scripts,
 {_count("= 'iframe'")} as iframes, (select count(*) from lk where lk.page_id = br.page_id) as links, (select count(*) from lk where lk.page_id = br.page_id and internal) as internal_links,
 (select count(*) from an0 where an0.page_id = br.page_id and starts_with(raw, 'tel:')) as tel, (select coalesce(max('ventas@tienda.es'), '') from an0 where an0.page_id = br.page_id and starts_with(raw, 'mailto:')) as mailto,
 {_count("in ('nav')")} > 0 as has_nav, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))::bigint as words, md5(text) as text
from br""", PAGES)
def page_features(t):
    n = lambda c, name: F.size(c).cast("bigint").alias(name)
    return _feats(t).select(
        "page_id", "title", F.col("meta_description").alias("description"), "viewport", "generator", F.col("robots_meta").alias("robots"), "lang",
        F.col("h1_count").cast("bigint").alias("h1_count"), n("images", "images"), n("scripts", "scripts"), F.col("inline_scripts").cast("bigint").alias("inline_scripts"),
        n("iframes", "iframes"), n("links", "links"), n(F.filter("links", lambda x: x["internal"]), "internal_links"), n("tel_links", "tel"),
        F.lower(F.array_join("mailto_links", ",")).alias("mailto"), "has_nav", F.col("word_count").alias("words"), F.md5("text").alias("text"))


@query("page_links", (PAGE,), "select page_id, href, text, internal from lk", PAGES)
def page_links(t):
    return PG.page_links(_feats(t, "page_id", "links"), "page_id").select("page_id", "href", "text", "internal")


@query("page_flags", (PAGE,), f"""
select page_id, starts_with(url, 'https:') and (contains(bare, 'http://cdn.example.org') or contains(bare, 'http://static.pexels')) as mixed,
 case when page_id % 29 <> 3 and page_id % 11 = 8 then 'font,center' else '' end as deprecated, page_id % 29 <> 3 and page_id % 11 = 8 as flash, page_id % 29 <> 3 and page_id % 11 = 8 as table_layout,
 coalesce(regexp_matches({_meta('viewport')}, 'width\\s*=\\s*[0-9]{{3,4}}'), false) as fixed_viewport, contains(bare, 'google.com/maps') as has_map, {_count("= 'script'")} > 0 and contains(bare, 'id="root"') as app_shell
from br""", PAGES)
def page_flags(t):
    needed = ("page_id", "mixed_content", "deprecated_tags", "uses_flash", "table_layout", "fixed_viewport", "has_map", "app_shell")
    return _feats(t, *needed).select(
        "page_id", (F.size("mixed_content") > 0).alias("mixed"), F.array_join("deprecated_tags", ",").alias("deprecated"), F.col("uses_flash").alias("flash"),
        "table_layout", "fixed_viewport", "has_map", "app_shell")


@query("a11y_counts", (PAGE,), f"""
select page_id, {_count("= 'img'", _attr('raw', 'alt') + ' is null')} as images_without_alt, (select count(*) from an0 where an0.page_id = br.page_id and raw is not null and text = '') as links_without_text,
 case when page_id % 29 <> 3 and page_id % 11 = 9 then 1 else 0 end as buttons_without_name, case when page_id % 29 <> 3 and page_id % 11 = 3 then 2 else 0 end as inputs_without_label from br""", PAGES)
def a11y_counts(t):
    counts = ("images_without_alt", "links_without_text", "buttons_without_name", "inputs_without_label")
    return _feats(t, "page_id", *counts).select("page_id", *[F.col(c).cast("bigint").alias(c) for c in counts])


@query("page_forms", (PAGE,), "select page_id, 4 as fields, true as has_email, true as has_textarea from fx_page where page_id % 11 = 3 and page_id % 29 <> 3")
def page_forms(t):
    return _feats(t, "page_id", "forms").select("page_id", F.inline("forms")).select("page_id", F.col("fields").cast("bigint").alias("fields"), "has_email", "has_textarea")


_BH = values([(i, h) for i, h in enumerate(BOOKING_HOSTS)])


@query("booking_links", (PAGE,), f"""
select page_id, url, label from (select *, row_number() over (partition by page_id, url order by pri, k, j) as rn from (
 select page_id, href as url, case when h is not null then coalesce(nullif(text,''), h) when regexp_matches(text, {ansi(P.BOOKING_TEXT)}) and not regexp_matches(text, {ansi(P.RIGHTS_RESERVED)}) then text
   when internal and regexp_matches(path, {ansi(P.BOOKING_PATH)}) then coalesce(nullif(text,''), 'Página de cita/reserva') end as label, 1 as pri, k, 0 as j from (select *, (select arg_min(h, i) from (values {_BH}) as v(i, h) where contains(lower(href), h)) as h from lk)
 union all select page_id, href, p.label, 1, k, 1 from lk join (values {PLATFORM_VALUES}) as p(seq, domain, kind, label) on (lhost = domain or ends_with(lhost, '.' || domain)) and kind in ('BOOKING_PLATFORM','DELIVERY')
 union all select page_id, url, 'Pedir cita', 2, 0, 0 from br where contains(bare, 'value="Pedir cita"')) where label is not null) where rn = 1""", PAGES)
def booking_links(t):
    return _feats(t, "page_id", "booking_signals").select("page_id", F.inline("booking_signals"))


@query("menu_links", (PAGE,), f"select page_id, href as url, regexp_matches(href, {ansi(P.PDF_LINK)}) as is_pdf from lk where regexp_matches(text, {ansi(P.MENU_TEXT)}) or regexp_matches(path, {ansi(P.MENU_PATH)})", PAGES)
def menu_links(t):
    return _feats(t, "page_id", "menu_links").select("page_id", F.inline("menu_links"))


@query("contact_pages", (PAGE,), f"""
select page_id, 'page' as kind, href as value from lk where internal and (regexp_matches(path, {ansi(P.CONTACT_LINK)}) or regexp_matches(text, {ansi(P.CONTACT_LINK)}))
union all select distinct page_id, 'cta', text from lk where length(text) <= 40 and regexp_matches(text, {ansi(P.CTA)})
union all select page_id, 'cta', 'Pedir cita' from br where contains(bare, 'value="Pedir cita"') union all select page_id, 'cta', 'tel:' from br where contains(bare, 'href="tel:')""", PAGES)
def contact_pages(t):
    f = _feats(t, "page_id", "contact_pages", "cta_texts")
    return f.select("page_id", F.lit("page").alias("kind"), F.explode("contact_pages").alias("value")).unionByName(
        f.select("page_id", F.lit("cta").alias("kind"), F.explode("cta_texts").alias("value")))


@query("tech_stack", (PAGE,), """
select page_id, case when page_id % 29 = 3 then null when page_id % 7 = 2 then 'WordPress 5.8.1' when page_id % 7 = 3 then 'Joomla! 2.5' end as cms,
 case when page_id % 29 = 3 then null when page_id % 7 = 2 then '1.12.4' when page_id % 7 = 6 then '3.6.0' end as jquery from fx_page""")
def tech_stack(t):
    return PG.tech_stack(_feats(t, "page_id", "generator", "scripts")).select("page_id", "cms", "jquery")


@query("js_only_pages", (PAGE,), "select page_id from fx_page where page_id % 29 = 3")
def js_only_pages(t):
    return _feats(t, "page_id", "word_count", "scripts", "inline_scripts", "app_shell", "noscript_js").where(PG.js_only()).select("page_id")


@query("jsonld_facts", (PAGE,), """
select page_id, case page_id % 7 when 4 then 'Restaurant' else 'Organization,Thing,WebSite' end as types, case page_id % 7 when 4 then '+34 954 12 34 56' else '954 00 11 22,+34 600 111 222' end as telephone,
 case page_id % 7 when 4 then 'info@casapepe.es' else '' end as email, case page_id % 7 when 4 then '41003' else '' end as postal_code, case page_id % 7 when 4 then 'Calle Feria 12' else '' end as street_address,
 case page_id % 7 when 4 then '1 09:00-20:30,2 09:00-20:30' else '1 10:00-14:00,2 10:00-14:00,3 10:00-14:00,4 10:00-14:00,5 10:00-14:00,1 17:00-20:00,2 17:00-20:00,3 17:00-20:00,4 17:00-20:00,5 17:00-20:00,6 10:00-14:00' end as hours,
 case page_id % 7 when 4 then 'https://www.instagram.com/casapepe/' else '' end as same_as from fx_page where page_id % 7 in (4, 5) and page_id % 29 <> 3""")
def jsonld_facts(t):
    j = lambda c: F.array_join(F.col(f"schema.{c}"), ",").alias(c)
    hours = F.array_join(F.transform("schema.opening_hours", lambda p: F.concat(p["day"].cast("string"), F.lit(" "), p["open"], F.lit("-"), p["close"])), ",")
    return _feats(t, "page_id", "schema").where(F.size("schema.types") > 0).select(
        "page_id", j("types"), j("telephone"), j("email"), j("postal_code"), j("street_address"), hours.alias("hours"), j("same_as"))


@query("jsonld_nested", ("fx_nested_ld",), """
select page_id, count(*) as nodes, count(*) filter (where v ->> '$."@type"' = 'Shell') as shells, max(v ->> '$.name') filter (where v ->> '$."@type"' = 'Store') as store,
 max(v ->> '$.telephone') as telephone, max(v ->> '$."@type"[1]') as last_type
from (with recursive w as (
  select page_id, body::json as v from fx_nested_ld union all
  select page_id, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') when json_type(v -> '$."@graph"') = 'ARRAY' then json_extract(v, '$."@graph"[*]') else [v -> '$."@graph"'] end) as v
  from w where json_type(v) = 'ARRAY' or json_type(v -> '$."@graph"') is not null) select * from w) where json_type(v) = 'OBJECT' and json_type(v -> '$."@type"') is not null group by 1""")
def jsonld_nested(t):
    nodes = T.let(F.array(F.try_parse_json("body")), lambda docs: HT.ld_nodes(docs))
    text = lambda n, path: F.try_variant_get(n, path, "string")
    kind = lambda n, name: text(n, "$['@type']") == name
    found = t["fx_nested_ld"].select("page_id", nodes.alias("n"))
    return found.select(
        "page_id", F.size("n").cast("bigint").alias("nodes"), F.size(F.filter("n", lambda n: kind(n, "Shell"))).cast("bigint").alias("shells"),
        text(F.get(F.filter("n", lambda n: kind(n, "Store")), F.lit(0)), "$.name").alias("store"),
        F.array_max(F.transform("n", lambda n: text(n, "$.telephone"))).alias("telephone"),
        F.array_max(F.transform("n", lambda n: text(n, "$['@type'][1]"))).alias("last_type"))


@query("social_links", (PAGE,), """
select page_id, 'INSTAGRAM' as type, case when starts_with(url, 'https') then 'https' else 'http' end || '://www.instagram.com/bar.foo' as profile from fx_page where page_id % 11 = 10 and page_id % 29 <> 3
union all select page_id, 'X', 'https://x.com/barfoo' from fx_page where page_id % 11 = 10 and page_id % 29 <> 3
union all select page_id, 'FACEBOOK', 'https://www.facebook.com/bar1' from fx_page where page_id % 11 = 6 and page_id % 29 <> 3
union all select page_id, 'YOUTUBE', 'https://www.youtube.com/c/bar' from fx_page where page_id % 11 = 6 and page_id % 29 <> 3
union all select page_id, 'WHATSAPP', 'https://wa.me/34600111222' from fx_page where page_id % 11 = 1 and page_id % 29 <> 3""")
def social_links(t):
    return PG.social_links(PG.page_links(_feats(t, "page_id", "links"), "page_id"), "page_id")


_KINDS = "case " + " ".join(f"when regexp_matches(text || ' ' || path, {ansi(p)}) then '{k}'" for k, p in P.FRONTIER_KINDS) + " end"


_HOME = ("business_id", "seq", "url", "links", "contact_pages")


@query("crawl_frontier", (PAGE,), f"""
select business_id, page_url, kind from (select *, row_number() over (partition by business_id order by pri, k) as position from (
 select *, row_number() over (partition by business_id, page_url order by pri, k) as rn from (
  select business_id, regexp_replace(regexp_replace(href, '#.*$', ''), '/$', '') as page_url, 'contact' as kind, 0 as pri, k, path from lk where seq = 0 and internal and (regexp_matches(path, {ansi(P.CONTACT_LINK)}) or regexp_matches(text, {ansi(P.CONTACT_LINK)}))
  union all select business_id, regexp_replace(regexp_replace(href, '#.*$', ''), '/$', ''), {_KINDS}, 1, k, path from lk where seq = 0 and internal)
 where kind is not null and not regexp_matches(path, {ansi(P.BINARY_PATH)})) where rn = 1)""", PAGES)
def crawl_frontier(t):
    return PG.frontier(_feats(t, *_HOME).where("seq = 0")).select("business_id", "page_url", "kind")


SITE_RULES = """
rln as (select business_id, trim(regexp_replace(l, '#.*$', ''), E' \\t\\r') as l, i as seq from (select business_id, unnest(string_split(content, chr(10))) as l, generate_subscripts(string_split(content, chr(10)), 1) as i from fx_site_robots)),
rkv as (select business_id, seq, lower(trim(split_part(l, ':', 1))) as name, trim(substr(l, strpos(l, ':') + 1)) as value from rln where contains(l, ':')),
rgr as (select *, sum(op) over (partition by business_id order by seq) as grp from (select *, case when name = 'user-agent' and coalesce(lag(name) over (partition by business_id order by seq), '') <> 'user-agent' then 1 else 0 end as op from rkv)),
rsp as (select *, bool_or(name = 'user-agent' and value <> '*' and contains('sitecheck', lower(value))) over (partition by business_id, grp) as spec, bool_or(name = 'user-agent' and value = '*') over (partition by business_id, grp) as gen from rgr),
rule as (select business_id, name, value, '^' || replace(regexp_replace(regexp_replace(value, '([.+?^{}()|$])', '\\\\\\1', 'g'), '\\\\\\$$', '$'), '*', '.*') as re
 from (select *, bool_or(spec) over (partition by business_id) as anyspec from rsp) where value <> '' and name in ('allow', 'disallow') and grp > 0 and case when anyspec then spec else gen end)
"""


def _may(path):
    """SQL truth value of a path under the rules of the row's business."""
    return (f"coalesce((select arg_max(r.name = 'allow', length(r.value) * 2 + (r.name = 'allow')::int) from rule r "
            f"where r.business_id = c.business_id and regexp_matches({path}, r.re)), true)")


def _site_rules(t):
    return RO.parse_robots(t["fx_site_robots"], key="business_id")


@query("crawl_frontier_robots", (PAGE, "fx_site_robots"), f"""
select business_id, page_url, kind, row_number() over (partition by business_id order by pri, k) as position from (
 select c.* from (select *, row_number() over (partition by business_id, page_url order by pri, k) as rn from (
  select business_id, regexp_replace(regexp_replace(href, '#.*$', ''), '/$', '') as page_url, 'contact' as kind, 0 as pri, k, path, href from lk where seq = 0 and internal and (regexp_matches(path, {ansi(P.CONTACT_LINK)}) or regexp_matches(text, {ansi(P.CONTACT_LINK)}))
  union all select business_id, regexp_replace(regexp_replace(href, '#.*$', ''), '/$', ''), {_KINDS}, 1, k, path, href from lk where seq = 0 and internal)
 where kind is not null and not regexp_matches(path, {ansi(P.BINARY_PATH)})) c where rn = 1 and {_may("regexp_extract(c.href, '://[^/?#]*([^#]*)', 1)")})""", PAGES + "," + SITE_RULES)
def crawl_frontier_robots(t):
    found = PG.frontier(_feats(t, *_HOME).where("seq = 0"), _site_rules(t), max_pages=None)
    return found.select("business_id", "page_url", "kind", F.col("position").cast("bigint").alias("position"))


_ABS = """case when {u} is null or {u} = '' or starts_with({u}, '#') or regexp_matches({u}, '(?i)^(javascript|data):') then null when regexp_matches({u}, '^https?:') then {u} when starts_with({u}, '//') then split_part(url, ':', 1) || ':' || {u}
 when starts_with({u}, '/') then regexp_extract(url, '^[a-z]+://[^/?#]*') || {u} else regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || {u} end"""
_SRC = f"coalesce({_attr('raw', 'src')}, {_attr('raw', 'data-src')})"


@query("link_targets", (PAGE, "fx_site_robots"), f"""
select business_id, kind as target_kind, position, target_url from (select *, row_number() over (partition by business_id, kind order by seq, ord, target_url) as position from (
 select business_id, kind, target_url, arg_min(seq, (seq, ord)) as seq, arg_min(ord, (seq, ord)) as ord from (
  select c.business_id, 'link' as kind, regexp_replace(c.href, '#.*$', '') as target_url, c.seq, c.k as ord from lk c where internal
   and not exists (select 1 from fx_page f where f.business_id = c.business_id and regexp_replace(f.url, '/$', '') = regexp_replace(regexp_replace(c.href, '#.*$', ''), '/$', '')) and {_may("regexp_extract(c.href, '://[^/?#]*([^#]*)', 1)")}
  union all select tg.business_id, 'image', target, tg.seq, tg.k from (select tgs.*, {_ABS.format(u='v')} as target from (select t.*, p.business_id, p.seq, p.url, {_SRC} as v from tg t join fx_page p using (page_id) where name = 'img') tgs) tg where regexp_matches(target, '(?i)^https?:')
  union all select tg.business_id, 'resource', target, tg.seq, tg.k + case name when 'link' then 1000000 else 0 end from (select tgs.*, {_ABS.format(u='v')} as target from (
    select t.*, p.business_id, p.seq, p.url, case name when 'script' then {_attr('raw', 'src')} else {_attr('raw', 'href')} end as v from tg t join fx_page p using (page_id) where name = 'script' or (name = 'link' and regexp_matches(lower(coalesce({_attr('raw', 'rel')}, '')), '(^|\\s)stylesheet(\\s|$)'))) tgs) tg where regexp_matches(target, '(?i)^https?:')
  union all select c.business_id, 'domain', c.lhost, c.seq, c.k from lk c where not internal and c.lhost <> '' and not exists (select 1 from (values {PLATFORM_VALUES}) as pl(s, d, kd, lb) where (d <> 'google.com' or starts_with(c.path, '/maps')) and (c.lhost = d or ends_with(c.lhost, '.' || d)))
   and {HOST_PARTS.format(h='c.lhost')} <> {HOST_PARTS.format(h='c.host')}) group by 1, 2, 3))
where position <= case kind when 'link' then 25 when 'domain' then 10 else 15 end""", PAGES + "," + SITE_RULES)
def link_targets(t):
    pages = _feats(t, "business_id", "seq", "url", "links", "images", "scripts", "stylesheets").withColumn("home_host", U.parse(F.col("url"))["host"])
    found = LI.link_targets(pages, t[PAGE].select("business_id", "url"), _site_rules(t), LI.QUOTAS)
    return found.withColumn("position", F.col("position").cast("bigint"))
