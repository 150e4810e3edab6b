"""Text, URL and phone functions: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phone as PH
from ..functions import text as T
from ..functions import url as U
from ..rules import patterns as P
from ..rules.phones import PHONE_PLANS
from ..rules.platforms import CONTACT_TYPE_BY_LABEL, TWO_LEVEL_SUFFIXES, flat_platforms
from ..rules.regex import BLANKS, ansi
from .registry import query
from .sqltext import quoted, values

L = "fx_lead_text"
PLATFORM_VALUES = values([(i, d, k, lab) for i, d, k, lab in flat_platforms()])
HOST_PARTS = (
    "(select case when len(p) <= 2 then array_to_string(p, '.') when array_to_string(p[-2:], '.') in (" + quoted(TWO_LEVEL_SUFFIXES)
    + ") then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end from (select string_split(regexp_replace(regexp_replace(lower({h}), '\\.$', ''), '^www\\.', ''), '.') as p))"
)
WS = f"[{BLANKS}]"
WSCLASS = f"'{WS}+'"


def _trim(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squeeze(x):
    return _trim(f"regexp_replace({x}, {WSCLASS}, ' ', 'g')")


def _norm(x):
    return _squeeze(f"lower(strip_accents({x}))")


def _snip(text, idx, mlen, radius):
    """SQL snippet round a zero-based position."""
    return (f"case when {idx} > {radius} then '…' else '' end || " + _squeeze(
        f"substr({text}, greatest(0, {idx} - {radius}) + 1, least(length({text}), {idx} + {mlen} + {radius}) - greatest(0, {idx} - {radius}))")
        + f" || case when {idx} + {mlen} + {radius} < length({text}) then '…' else '' end")


def _hit(text, pattern):
    """(start, length) SQL of a first match; the pattern must not need context outside the match."""
    m = f"regexp_extract({text}, {ansi(pattern)})"
    return f"(strpos({text}, {m}) - 1)", f"length({m})"


def _match_snip(text, pattern, radius):
    i, n = _hit(text, pattern)
    return f"case when regexp_matches({text}, {ansi(pattern)}) then {_snip(text, i, n, radius)} end"


@query("text_normalize", (), f"select doc_id, md5({_norm('text')}) as normalized from documents")
def text_normalize(t):
    return t["documents"].select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normalized"))


@query("text_snippets", (L,), f"""
select doc_id, case when length(ad_text) <= 50 then ad_text else regexp_replace(substr(ad_text, 1, 49), '{WS}+$', '') || '…' end as short,
 {_match_snip('ad_text', P.STALE_COVID, 70)} as covid, {_match_snip('ad_text', 'the|les', 20)} as word from fx_lead_text""")
def text_snippets(t):
    c = F.col("ad_text")
    return t[L].select("doc_id", T.truncate(c, 50).alias("short"), T.match_snippet(c, P.STALE_COVID).alias("covid"),
                       T.match_snippet(c, "the|les", 20).alias("word"))


@query("name_coverage", ("fx_named_text",), f"""
select doc_id, n, case when n = 0 then 0 else round(h::double / n, 6) end as coverage from (
 select doc_id, len(toks) as n, len(list_filter(toks, lambda x: contains(hay, x))) as h from (
  select doc_id, list_filter(string_split(regexp_replace({_norm("name")}, '[^a-z0-9ñ ]', ' ', 'g'), ' '), lambda x: length(x) >= 3 and x not in ({quoted(P.NAME_STOPWORDS)})) as toks,
   {_norm("ad_text")} as hay from fx_named_text))""")
def name_coverage(t):
    name, hay = F.col("name"), F.col("ad_text")
    return t["fx_named_text"].select("doc_id", F.size(T.name_tokens(name)).cast("bigint").alias("n"),
                       F.round(T.name_coverage(name, hay), 6).alias("coverage"))


@query("word_count", (), r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+'))::bigint as words from documents")
def word_count(t):
    return t["documents"].select("doc_id", T.words(F.col("text")).alias("words"))


_PLANS = values([(p.country, p.calling_code, p.min_len, p.max_len, p.trunk, p.valid) for p in PHONE_PLANS])
_PHONE = f"""
plan(country, code, lo, hi, trunk, valid) as (values {_PLANS}),
prep as (select *, trim(regexp_replace(raw, '(?i)^tel:', '')) as c from fx_phone),
prep2 as (select *, regexp_replace(c, '[^0-9]', '', 'g') as digits, regexp_matches(c, '^\\(?(\\+|00)') as abroad from prep),
prep3 as (select *, case when starts_with(c, '+') then digits else regexp_replace(digits, '^00', '') end as rest from prep2),
pl as (select r.id, p.* from (select p3.id, case when abroad then (select arg_max(country, length(code)) from plan where starts_with(rest, code)) else upper(country) end as pc from prep3 p3) r join plan p on p.country = r.pc),
num as (select p.id, code, lo, hi, c, case when trunk <> '' and starts_with(loc, trunk) then substr(loc, length(trunk) + 1) else loc end as nsn from (select p3.id, c, pl.*, case when abroad then substr(rest, length(code) + 1) else digits end as loc from prep3 p3 join pl on pl.id = p3.id) p)
"""


@query("phone_normalize", ("fx_phone",), """
select f.id, '+' || code || nsn as e164, case when code = '34' then substr(nsn,1,3) || ' ' || substr(nsn,4,2) || ' ' || substr(nsn,6,2) || ' ' || substr(nsn,8) end as es_national
from fx_phone f left join (select * from num where length(nsn) between lo and hi and regexp_matches(c, '^[+0-9(][0-9 ().\\-/]*$')) n on n.id = f.id""", _PHONE)
def phone_normalize(t):
    raw, country = F.col("raw"), F.col("country")
    return t["fx_phone"].select("id", PH.e164(raw, country).alias("e164"),
                                F.when(PH.e164(raw, country).startswith("+34"), PH.national(raw, country)).alias("es_national"))


@query("same_phone", ("fx_business",), "select business_id, coalesce(business_id % 3 = 0 and national_phone is not null, false) as same from fx_business")
def same_phone(t):
    p = F.col("national_phone")
    other = F.when(F.col("business_id") % 3 == 0, F.concat(F.lit("+34 "), p)).otherwise(F.concat(F.lit("+351"), p))
    return t["fx_business"].select("business_id", PH.same_phone(p, other, F.lit("ES")).alias("same"))


@query("phones_in_text", (L,), f"""
select doc_id, array_to_string(list_distinct_ordered, ',') as phones from (
 select f.doc_id, coalesce((select list(e order by k) from (select e, min(k) as k from (
   select '+' || code || nsn as e, k from (
     select k, p.code, p.valid, p.lo, p.hi, case when p.trunk <> '' and starts_with(loc, p.trunk) then substr(loc, length(p.trunk) + 1) else loc end as nsn from (
       select k, c, regexp_replace(c, '[^0-9]', '', 'g') as digits, regexp_matches(c, '^\\(?(\\+|00)') as abroad, case when starts_with(c, '+') then regexp_replace(c, '[^0-9]', '', 'g') else regexp_replace(regexp_replace(c, '[^0-9]', '', 'g'), '^00', '') end as rest
       from (select unnest(regexp_extract_all(f.ad_text, '(?:^|[^0-9+A-Za-z])((?:\\+|00)?[(]?[0-9](?:[ ().-]?[0-9]){{7,14}})(?:[^0-9]|$)', 1)) as c, generate_subscripts(regexp_extract_all(f.ad_text, '(?:^|[^0-9+A-Za-z])((?:\\+|00)?[(]?[0-9](?:[ ().-]?[0-9]){{7,14}})(?:[^0-9]|$)', 1), 1) as k)) r
     join (select *, length(code) as cl from (values {_PLANS}) as v(country, code, lo, hi, trunk, valid)) p on case when abroad then p.code = (select arg_max(code, length(code)) from (values {_PLANS}) as w(country, code, lo, hi, trunk, valid) where starts_with(rest, w.code)) else p.country = 'ES' end
     cross join lateral (select case when abroad then substr(rest, p.cl + 1) else digits end as loc) x
   ) where length(nsn) between lo and hi and regexp_matches(nsn, valid)) group by e)), []) as list_distinct_ordered from fx_lead_text f)""")
def phones_in_text(t):
    return t[L].select("doc_id", F.array_join(PH.phones_in_text(F.col("ad_text"), F.lit("ES")), ",").alias("phones"))


@query("emails_in_text", (L,), f"""
select doc_id, coalesce((select string_agg(e, ',' order by k) from (select e, k from (select e, min(k) as k from (
  select lower(regexp_replace({_trim('e')}, '^[.]+|[.]+$', '', 'g')) as e, k from (select unnest(regexp_extract_all(f.ad_text, {ansi(P.EMAIL)}, 1)) as e, generate_subscripts(regexp_extract_all(f.ad_text, {ansi(P.EMAIL)}, 1), 1) as k))
  where regexp_matches(e, {ansi(P.EMAIL_SHAPE)}) and {' and '.join(f'not regexp_matches(e, {ansi(b)})' for b in P.EMAIL_BLOCKED)} group by e) order by k)), '') as emails from fx_lead_text f""")
def emails_in_text(t):
    return t[L].select("doc_id", F.array_join(T.emails(F.col("ad_text")), ",").alias("emails"))


@query("email_decode", (), "select c_custkey as id, case when c_custkey % 10 = 0 then null else 'info.' || c_custkey || '@bar.es' end as email from customer")
def email_decode(t):
    plain = F.concat(F.lit("info."), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, " at ").otherwise("@"), F.lit("bar.es"))
    key = (F.col("c_custkey") % 250 + 1).cast("int")
    two = lambda n: F.lpad(F.hex(n), 2, "0")
    coded = F.concat(two(key), F.array_join(F.transform(F.split(plain, ""), lambda ch: F.when(ch == "", "").otherwise(two(F.ascii(ch).bitwiseXOR(key)))), ""))
    return t["customer"].select(F.col("c_custkey").alias("id"), T.hidden_email(coded).alias("email"))


@query("copyright_years", (L,), f"""
select doc_id, coalesce((select string_agg(y::varchar, ',' order by k) from (select y, min(k) as k from (select greatest(a::int, coalesce(try_cast(nullif(b, '') as int), 0)) as y, k from (
  select unnest(regexp_extract_all(f.ad_text, {ansi(P.COPYRIGHT)}, 1)) as a, unnest(regexp_extract_all(f.ad_text, {ansi(P.COPYRIGHT)}, 2)) as b, generate_subscripts(regexp_extract_all(f.ad_text, {ansi(P.COPYRIGHT)}, 1), 1) as k)) where y between 1995 and 2100 group by y)), '') as years from fx_lead_text f""")
def copyright_years(t):
    return t[L].select("doc_id", F.array_join(F.transform(T.copyright_years(F.col("ad_text")), lambda y: y.cast("string")), ",").alias("years"))


def _matches(pattern, group=0):
    """SQL: one row per match (k, hit, pos) of f.ad_text, pos = zero-based start, from the pieces between matches."""
    p = ansi(pattern)
    return (f"(select k, hit, (sum(length(gap)) over (order by k) + coalesce(sum(length(hit)) over (order by k rows between unbounded preceding and 1 preceding), 0))::bigint as pos from "
            f"(select unnest(regexp_extract_all(f.ad_text, {p})) as hit, unnest(regexp_split_to_array(f.ad_text, {p})) as gap, generate_subscripts(regexp_split_to_array(f.ad_text, {p}), 1) as k) where hit is not null)")


@query("dated_mentions", (L,), f"""
select doc_id, coalesce((select string_agg(hit || ':' || {_snip('f.ad_text', 'pos', '4', 60)}, '|' order by k) from (select * from (select *, row_number() over (order by k) as rn from {_matches('(?:19|20)[0-9][0-9]')} m
 where hit::int between 2000 and 2022 and regexp_matches(substr(f.ad_text, greatest(0, pos - 45)::int + 1, (pos + 10 - greatest(0, pos - 45))::int), {ansi(P.EVENT_WORDS)})
 and not regexp_matches(substr(f.ad_text, greatest(0, pos - 30)::int + 1, (pos - greatest(0, pos - 30))::int), {ansi(P.SINCE_WORDS)})))), '') as mentions from fx_lead_text f""")
def dated_mentions(t):
    m = T.dated_mentions(F.col("ad_text"), 2024)
    return t[L].select("doc_id", F.array_join(F.transform(m, lambda x: F.concat(x["year"].cast("string"), F.lit(":"), x["text"])), "|").alias("mentions"))


@query("stale_notices", (L,), f"""
select doc_id, 'covid' as kind, {_match_snip('ad_text', P.STALE_COVID, 70)} as text from fx_lead_text where regexp_matches(ad_text, {ansi(P.STALE_COVID)})
union all select doc_id, 'temporarily_closed', {_match_snip('ad_text', P.TEMPORARILY_CLOSED, 70)} from fx_lead_text where regexp_matches(ad_text, {ansi(P.TEMPORARILY_CLOSED)})""")
def stale_notices(t):
    return t[L].select("doc_id", F.inline(T.stale_notices(F.col("ad_text"))))


@query("hours_text_hits", (L,), f"""
select doc_id, coalesce((select string_agg({_snip('f.ad_text', 'pos', 'length(hit)', 25)}, '|' order by k) from {_matches(P.HOURS_TEXT)}), '') as hours from fx_lead_text f""")
def hours_text_hits(t):
    return t[L].select("doc_id", F.array_join(T.hours_texts(F.col("ad_text")), "|").alias("hours"))


@query("address_text_hits", (L,), f"""
select doc_id, coalesce((select string_agg(a, '|' order by k) from (select a, min(k) as k from (select {_trim('h')} as a, k from (select unnest(regexp_extract_all(f.ad_text, {ansi(P.ADDRESS_TEXT)})) as h, generate_subscripts(regexp_extract_all(f.ad_text, {ansi(P.ADDRESS_TEXT)}), 1) as k)) group by a)), '') as addresses from fx_lead_text f""")
def address_text_hits(t):
    return t[L].select("doc_id", F.array_join(T.address_texts(F.col("ad_text")), "|").alias("addresses"))


@query("postal_codes", (L,), f"""
select doc_id, coalesce((select string_agg(hit, ',' order by k) from (select hit, min(k) as k from {_matches(P.POSTAL_CODE)} m
 where regexp_matches(substr(f.ad_text, greatest(0, pos - 80)::int + 1, (pos + 40 - greatest(0, pos - 80))::int), {ansi(P.POSTAL_CONTEXT)}) group by hit order by k)), '') as codes from fx_lead_text f""")
def postal_codes(t):
    return t[L].select("doc_id", F.array_join(T.postal_codes(F.col("ad_text")), ",").alias("codes"))


_KIND = "case when regexp_matches(s, {0}) and w < 400 then 'PARKED' when regexp_matches(s, {1}) and w < 250 then 'UNDER_CONSTRUCTION' when regexp_matches(s, {2}) then 'PLACEHOLDER' end".format(
    ansi(P.PARKED), ansi(P.UNDER_CONSTRUCTION), ansi(P.PLACEHOLDER))


@query("placeholder_text", (L,), f"select doc_id, kind from (select doc_id, {_KIND} as kind from (select doc_id, ad_text as s, len(regexp_extract_all(ad_text, '[\\p{{L}}\\p{{N}}]+')) as w from fx_lead_text))")
def placeholder_text(t):
    return t[L].select("doc_id", T.placeholder_kind(F.col("ad_text")).alias("kind"))


_DIRTY = "text || ' https://x.es/a?key=abc&u=1&token=zz ' || 'postgres://u' || doc_id || ':p' || doc_id || '@db BEARER x Bearer ab.c=='"


@query("redact_secrets", (), f"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_DIRTY}, {ansi(P.SECRETS_IN_TEXT[0][0])}, '\\1[REDACTED]', 'g'), {ansi(P.SECRETS_IN_TEXT[1][0])}, '\\1[REDACTED]\\2', 'g'), {ansi(P.SECRETS_IN_TEXT[2][0], False)}, '\\1[REDACTED]', 'g')) as clean,
 '[REDACTED]' as api_key, doc_id::varchar as plain from documents""")
def redact_secrets(t):
    d = F.col("doc_id").cast("string")
    dirty = F.concat(F.col("text"), F.lit(" https://x.es/a?key=abc&u=1&token=zz "), F.lit("postgres://u"), d, F.lit(":p"), d, F.lit("@db BEARER x Bearer ab.c=="))
    m = T.redact_map(F.create_map(F.lit("X-API-Key"), d, F.lit("user"), d))
    return t["documents"].select("doc_id", F.md5(T.redact(dirty)).alias("clean"), m["X-API-Key"].alias("api_key"), m["user"].alias("plain"))


_URLS = f"""
u0 as (select url_id, url, {_trim('url')} as s from fx_url),
u1 as (select *, case when regexp_matches(s, '(?i)^[a-z][a-z0-9+.-]*://') then s else 'http://' || s end as f from u0),
u2 as (select *, lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_replace(regexp_extract(f, '://([^/?#]*)', 1), '^.*@', '') as auth, regexp_extract(f, '://[^/?#]*([^?#]*)', 1) as path0, regexp_extract(f, '(\\?[^#]*)', 1) as q0 from u1),
u3 as (select *, lower(regexp_replace(auth, ':[0-9]*$', '')) as host, regexp_extract(auth, '(:[0-9]+)$', 1) as port,
  case when path0 = '' then '/' else replace(replace(path0, ' ', '%20'), 'ñ', '%C3%B1') end as path, q0 as query from u2),
u4 as (select *, case when scheme in ('http','https') and regexp_matches(host, '^[^ #%/:<>?@^|\\\\\\[\\]]+$') then true else false end as ok from u3),
plat(seq, domain, kind, label) as (values {PLATFORM_VALUES}),
cls as (select url_id, arg_min(kind, seq) as kind, arg_min(label, seq) as label from u4 join plat p on (host = p.domain or ends_with(host, '.' || p.domain)) and (p.domain <> 'google.com' or starts_with(path, '/maps')) where ok group by 1)
"""


@query("url_parts", ("fx_url",), f"""
select url_id, case when ok then scheme || '://' || host || port || path || query end as normalized, case when ok then {HOST_PARTS.format(h='host')} end as domain,
 case when ok then regexp_replace(scheme || '://' || regexp_replace(host, '^(m|mobile|web|es-es|es-la)\\.', 'www.') || port || path, '/$', '') end as social,
 case when ok then regexp_replace(host, '^www\\.', '') end as label from u4""", _URLS)
def url_parts(t):
    p = U.website_parts(F.col("url"))
    return t["fx_url"].select("url_id", U.normalize_website(F.col("url")).alias("normalized"), U.registrable_domain(p["host"]).alias("domain"),
                              U.canonical_social(p).alias("social"), U.bare_host(p["host"]).alias("label"))


@query("classify_url", ("fx_url",), "select url_id, kind, label, coalesce(kind not in ('FREE_SUBDOMAIN_BUILDER','DISCONTINUED_BUILDER'), false) as not_own from u4 left join cls using (url_id)", _URLS)
def classify_url(t):
    df = t["fx_url"].withColumn("p", U.website_parts(F.col("url")))
    c = U.platform(F.col("p.host"), F.col("p.path"))
    return df.select("url_id", c["kind"].alias("kind"), c["label"].alias("label"), U.is_not_own_site(c["kind"]).alias("not_own"))


@query("contact_type_of_url", ("fx_url",), f"""
select url_id, case when kind is null then null when kind = 'MESSAGING' and regexp_matches(host, 'whatsapp|wa\\.me|wa\\.link') then 'WHATSAPP' when kind in ('BOOKING_PLATFORM','DELIVERY') then 'BOOKING_PAGE'
 else coalesce(v.t, 'OTHER') end as contact_type from u4 left join cls using (url_id) left join (values {values(list(CONTACT_TYPE_BY_LABEL.items()))}) as v(label, t) using (label)""", _URLS)
def contact_type_of_url(t):
    return t["fx_url"].select("url_id", U.contact_type(U.website_parts(F.col("url"))).alias("contact_type"))


@query("safe_links", ("fx_url",), """
select url_id, case when scheme2 in ('http','https') and not contains(regexp_extract(url, '//([^/]*)', 1), ' ') and starts_with(lower(trim(url)), 'http') then true else false end as is_url from (select *, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) as scheme2 from fx_url)""")
def safe_links(t):
    url = F.trim("url")
    return t["fx_url"].select("url_id", (U.safe_http(url).isNotNull() & url.rlike("(?i)^http")).alias("is_url"))
