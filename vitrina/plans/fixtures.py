"""Domain tables derived from the supplied tables by integer arithmetic on their keys.

Every derivation is one portable SELECT, so the same text feeds Spark and the SQL checks. ``SERIES(a, b)`` stands
for one row per integer and is the only construct written differently for the two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.platforms import flat_platforms
from ..session import spread

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
SPREAD_TABLES = ["documents", "pages", "customer"]  # small files with much work per row
AS_OF = "2024-01-15 12:00:00"


def now() -> Column:
    """The fixed clock of the registered queries."""
    return F.lit(AS_OF).cast("timestamp")


_TS = "timestamp '2024-01-01 00:00:00'"

FIXTURES: dict[str, str] = {}

FIXTURES["fx_business"] = f"""
select c.c_custkey as business_id,
  case when c.c_custkey % 3 = 0 then 'osm' else 'google_places' end as provider_key,
  concat('place-', cast(c.c_custkey as varchar(12))) as provider_place_id,
  concat(p.prefix, c.c_name) as name,
  k.category_key,
  n.n_name as city,
  'ES' as country_code,
  concat('Calle Mayor ', cast(c.c_custkey % 90 as varchar(4)), ', ', n.n_name) as formatted_address,
  case when c.c_custkey % 6 = 0 then null else concat('Calle Mayor, ', cast(c.c_custkey % 90 as varchar(4))) end as street,
  case when c.c_custkey % 5 = 0 then null else concat('41', lpad(cast(c.c_custkey % 60 as varchar(3)), 3, '0')) end as postal_code,
  case when c.c_custkey % 4 = 0 then null else concat('95', lpad(cast((c.c_custkey * 7919) % 9000000 as varchar(7)), 7, '0')) end as national_phone,
  case c.c_custkey % 8 when 0 then null
    when 1 then concat('https://www.facebook.com/biz', cast(c.c_custkey as varchar(12)))
    when 2 then concat('http://www.tienda', cast(c.c_custkey as varchar(12)), '.com.es/')
    when 3 then concat('https://pelu', cast(c.c_custkey as varchar(12)), '.wixsite.com/site')
    when 4 then concat('bar', cast(c.c_custkey as varchar(12)), '.es')
    when 5 then concat('https://mi', cast(c.c_custkey as varchar(12)), '.business.site/')
    when 6 then concat('ftp://files', cast(c.c_custkey as varchar(12)), '.es/x')
    else concat('https://Instagram.com/local.', cast(c.c_custkey as varchar(12)), '/?hl=es') end as provider_website,
  37.39D + ((c.c_custkey * 7919) % 1001 - 500) / 10000.0D as lat,
  -5.99D + ((c.c_custkey * 104729) % 1001 - 500) / 10000.0D as lng,
  case when c.c_custkey % 3 = 0 then null else coalesce(o.n, 0) end as user_rating_count,
  case when c.c_custkey % 3 = 0 then null else 1.0D + (c.c_custkey % 41) / 10.0D end as rating,
  case when c.c_custkey % 97 = 0 then 'CLOSED_PERMANENTLY' when c.c_custkey % 53 = 0 then 'CLOSED_TEMPORARILY' when c.c_custkey % 3 = 0 then null else 'OPERATIONAL' end as business_status,
  w.website_status,
  l.lead_status,
  c.c_custkey % 4 <> 0 as has_phone,
  c.c_custkey % 5 = 0 as has_email,
  case when w.website_status is null then null else (c.c_custkey * 37) % 101 end as opportunity_score,
  case when w.website_status is null then null when c.c_custkey % 13 = 0 then 'INSUFFICIENT_EVIDENCE' when (c.c_custkey * 37) % 101 >= 60 then 'HIGH' when (c.c_custkey * 37) % 101 >= 40 then 'MEDIUM' else 'LOW' end as opportunity_level,
  case when c.c_custkey % 9 = 0 then null else (c.c_custkey * 53) % 101 end as website_score,
  c.c_custkey % 2 = 0 as search_checked, c.c_custkey % 6 <> 0 as analysis_complete, c.c_custkey % 5 as reviews_analyzed,
  case when c.c_custkey % 4 = 3 then null else 100 - (c.c_custkey % 11) * 5 end as consistency_score,
  c.c_custkey % 4 as technical_issue_count,
  c.c_custkey % 3 as consistency_issue_count,
  case when w.website_status is null then null else {_TS} + interval '1' hour * (c.c_custkey % 700) end as last_analyzed_at,
  case when c.c_custkey % 4 = 1 then null else {_TS} + interval '1' minute * ((c.c_custkey * 61) % 43200) end as next_follow_up_at,
  {_TS} - interval '1' day * (c.c_custkey % 60) as provider_fetched_at
from customer c join nation n on n.n_nationkey = c.c_nationkey
left join (select o_custkey, count(*) as n from orders group by o_custkey) o on o.o_custkey = c.c_custkey
join (values (0,'restaurantes'),(1,'bares_cafeterias'),(2,'peluquerias_estetica'),(3,'gimnasios'),(4,'clinicas'),(5,'talleres'),(6,'tiendas'),(7,'abogados_asesorias'),(8,'alojamientos'),(9,'inmobiliarias'),(10,'veterinarios'),(11,'autoescuelas')) as k(i, category_key) on k.i = c.c_custkey % 12
join (values (0,'SIN_WEB'),(1,'WEB_CAIDA'),(2,'WEB_FUNCIONAL_CON_PROBLEMAS'),(3,'WEB_FUNCIONAL_CON_PROBLEMAS'),(4,'WEB_ACEPTABLE'),(5,'WEB_NO_VERIFICABLE'),(6,null)) as w(i, website_status) on w.i = c.c_custkey % 7
join (values (0,'NEW'),(1,'TO_CONTACT'),(2,'CONTACTED'),(3,'INTERESTED'),(4,'PROPOSAL_SENT'),(5,'WON'),(6,'LOST'),(7,'DISCARDED')) as l(i, lead_status) on l.i = c.c_custkey % 8
join (values (0,'Ayuntamiento de '),(1,'Café '),(2,'Peluquería Peña '),(3,' Centro de Salud '),(4,'Biblioteca Pública '),(5,'Comisaría '),(6,'=Taller '),(7,'Bar "El Niño"; ')) as p(i, prefix) on p.i = c.c_custkey % 8
"""

FIXTURES["fx_finding_raw"] = """
select l.l_orderkey % (select count(*) from customer) as business_id, (l.l_partkey * 10 + l.l_linenumber) * 100000 + l.l_suppkey as seq, r.code, r.category,
  v.severity, v.sev_rank, concat('Hallazgo ', lower(r.code)) as title, concat('Detalle ', cast(l.l_partkey as varchar(12))) as description,
  case when l.l_suppkey % 3 = 0 then 'MEDIUM' else 'HIGH' end as confidence, case when l.l_suppkey % 4 = 0 then 'INFERRED' else 'ANALYZED' end as provenance
from lineitem l
join (values (0,'NO_VIEWPORT','MOBILE'),(1,'NO_HTTPS','SECURITY'),(2,'MISSING_TITLE','SEO'),(3,'NO_FAVICON','UX'),(4,'PHONE_MISMATCH','CONSISTENCY'),(5,'HOURS_MISMATCH','CONSISTENCY'),(6,'OLD_COPYRIGHT','FRESHNESS'),(7,'REVIEW_WRONG_HOURS','REVIEWS'),(8,'REVIEW_PHONE_ONLY','REVIEWS'),(9,'NO_MENU','CONTENT'),(10,'NO_CONTACT_METHOD','CONTACT'),(11,'SLOW_RESPONSE','PERFORMANCE'),(12,'FREE_SUBDOMAIN','PRESENCE'),(13,'MISSING_LANG','ACCESSIBILITY'),(14,'WEBSITE_UNREACHABLE','AVAILABILITY'),(15,'NO_ONLINE_BOOKING','UX'),(16,'WEBSITE_IS_THIRD_PARTY','PRESENCE'),(17,'PROBABLE_PUBLIC_ENTITY','PRESENCE')) as r(i, code, category) on r.i = l.l_partkey % 18
join (values (0,'CRITICAL',0),(1,'HIGH',1),(2,'HIGH',1),(3,'MEDIUM',2),(4,'MEDIUM',2),(5,'MEDIUM',2),(6,'LOW',3),(7,'LOW',3),(8,'LOW',3),(9,'INFO',4)) as v(i, severity, sev_rank) on v.i = (l.l_suppkey + l.l_linenumber) % 10
"""

FIXTURES["fx_review"] = """
select conv_id * 1000 + turn as review_id, conv_id as business_id, turn as seq, (conv_id + turn) % 5 + 1 as rating,
  concat(p.phrase, ' ', text) as text
from conversations join (values (0,'El horario de Google está mal.'),(1,'No cogen el teléfono nunca.'),(2,'Imposible reservar online.'),(3,'Muy buen servicio.'),(4,'La DIRECCIÓN es incorrecta.'),(5,'Información desactualizada.'),(6,'Tuve que llamar.'),(7,'Su web no funciona y la carta de internet era otra.')) as p(i, phrase) on p.i = (conv_id * 3 + turn) % 8
where role = 'user'
"""

FIXTURES["fx_scan"] = """
select o_orderkey as scan_id, o_custkey as owner_business_id, o_orderdate as created_at,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'ANALYZING' else 'FAILED' end as status,
  floor(o_totalprice) / 100000.0D as estimated_cost_usd, o_orderkey % 60 as total_found, o_orderkey % 31 as total_analyzed, o_orderkey % 7 as total_failed,
  (o_orderkey * 31) % 97 as request_mix
from orders
"""

FIXTURES["fx_scan_business"] = """
select distinct l_orderkey as scan_id, (l_orderkey * 7 + l_linenumber * 13) % (select count(*) from customer) as business_id
from lineitem
"""

FIXTURES["fx_analysis"] = """
select o_orderkey as analysis_id, o_custkey as business_id, o_orderdate as created_at, (o_orderkey * 37) % 101 as opportunity_score,
  case when o_orderkey % 11 = 0 then 'PARTIAL' else 'COMPLETED' end as status from orders
"""

FIXTURES["fx_scan_usage"] = """
select l.l_orderkey as scan_id, k.sku, l.l_linenumber as n from lineitem l join (values (0,'google_text_search_pro'),(1,'google_text_search_enterprise'),(2,'google_text_search_enterprise_atmosphere'),(3,'search_brave'),(4,'osm_overpass')) as k(i, sku) on k.i = l.l_suppkey % 5
"""

FIXTURES["fx_lead_event"] = """
select event_id, ts, user_id as business_id, case event_type when 'view' then 'JOB_STARTED' when 'click' then 'JOB_DONE' when 'error' then 'JOB_FAILED' when 'purchase' then 'LEAD_PATCH' else 'REANALYZE' end as kind, event_id % 40 as scan_id, value from events
"""

FIXTURES["fx_contact"] = """
select l.l_orderkey % (select count(*) from customer) as business_id, (l.l_partkey * 10 + l.l_linenumber) * 100000 + l.l_suppkey as seq, k.type, concat(case when l.l_linenumber % 2 = 0 then k.type else lower(k.type) end, '-', cast(l.l_partkey % 50 as varchar(10))) as value, case when l.l_suppkey % 2 = 0 then 'listing' else 'website' end as source
from lineitem l
join (values (0,'PHONE'),(1,'EMAIL'),(2,'CONTACT_FORM'),(3,'WHATSAPP'),(4,'CONTACT_PAGE'),(5,'INSTAGRAM'),(6,'FACEBOOK'),(7,'BOOKING_PAGE'),(8,'TIKTOK'),(9,'LINKEDIN'),(10,'X'),(11,'YOUTUBE'),(12,'OTHER')) as k(i, type) on k.i = (l.l_partkey + l.l_suppkey) % 13
"""

FIXTURES["fx_hours"] = """
select c.c_custkey as business_id, c.day, 'listing' as side, '09:00' as open_at, case when c.c_custkey % 4 = 0 then '00:00' else '20:30' end as close_at
from (select c_custkey, SERIES(1, 6) as day from customer) c where (c.c_custkey + c.day) % 9 <> 0
union all
select c.c_custkey, c.day, 'website', v.open_at, v.close_at
from (select c_custkey, SERIES(1, 6) as day from customer) c
join (values (0,'09:00','20:30'),(0,'9:00','20:30'),(1,'09:00','20:30'),(1,'09:00','19:00'),(2,'10:00','14:00'),(2,'17:00','20:30'),(3,'09:00','23:59'),(4,'22:00','02:00')) as v(i, open_at, close_at) on v.i = c.c_custkey % 6
"""

FIXTURES["fx_search_hit"] = """
select c.c_custkey as business_id, c.rnk, concat('https://www.', h.host, '/p', cast(c.c_custkey as varchar(12))) as url, h.host,
 (c.c_custkey + c.rnk) % 11 = 0 as phone_match, ((c.c_custkey * 7 + c.rnk * 3) % 10) / 10.0D as name_coverage, (c.c_custkey + c.rnk) % 2 = 0 as location_hit,
 (c.c_custkey * 5 + c.rnk) % 17 <> 0 as readable
from (select c_custkey, SERIES(0, 7) as rnk from customer) c
join (values (0,'facebook.com'),(1,'bar-uno.es'),(2,'tripadvisor.es'),(3,'tienda.com.es'),(4,'pelu.wixsite.com'),(5,'bar-dos.es'),(6,'elpais.com'),(7,'tres.co.uk'),(8,'mi.business.site'),(9,'cuatro.es'),(10,'shop.bar-uno.es')) as h(i, host) on h.i = (c.c_custkey * 3 + c.rnk * 7) % 11
"""

FIXTURES["fx_web_hit"] = """
select c.c_custkey as business_id, c.rnk, concat('https://', case (c.c_custkey * 3 + c.rnk * 5) % 9 when 0 then 'www.facebook.com/biz' when 1 then concat('www.negocio', cast(c.c_custkey as varchar(12)), '.es/') when 2 then 'www.tripadvisor.es/x'
  when 3 then concat('tienda.negocio', cast(c.c_custkey as varchar(12)), '.es/t') when 4 then 'guia-local.es/sitio' when 5 then concat('pelu', cast(c.c_custkey as varchar(12)), '.wixsite.com/inicio') when 6 then 'elpais.com/n'
  when 7 then concat('www.otro', cast(c.c_custkey % 40 as varchar(4)), '.co.uk/') else 'bad host/x' end, '?r=', cast(c.rnk as varchar(2))) as url, 'Resultado' as title, 'Texto' as snippet
from (select c_custkey, SERIES(0, 7) as rnk from customer) c
"""

FIXTURES["fx_home_capture"] = """
select h.home as requested_url, h.attempt, case when h.id % 10 = 7 then concat(h.home, 'inicio') else h.home end as url,
 case when h.id % 13 = 5 then 404 when h.id % 17 = 3 then 503 else 200 end as status,
 case when h.id % 19 = 4 then 'application/pdf' when h.id % 3 = 0 then 'text/html; charset=utf-8' else 'text/html' end as content_type,
 case when h.id % 5 = 2 and h.attempt = 1 then 'TIMEOUT' when h.id % 23 = 9 then 'DNS_NOT_FOUND' end as error_code,
 concat('<html><head><title>', case h.id % 4 when 0 then h.name when 1 then concat('Bienvenidos a ', upper(h.name)) when 2 then 'Inicio' else concat('customer ', h.city) end, '</title></head><body><h1>',
  case when h.id % 2 = 0 then h.city else 'Portada' end, '</h1><p>', h.words, case when h.id % 3 = 1 then concat(' CP ', coalesce(h.postal_code, 'no')) else '' end, ' fin</p>',
  case when h.national_phone is null then '' when h.id % 6 in (1, 2) then concat('<a href="tel:+34', h.national_phone, '">Llamar</a>') when h.id % 6 = 3 then concat('<p>Tel. ', substring(h.national_phone, 1, 3), ' ', substring(h.national_phone, 4, 6), ' y listo</p>') else '' end,
  '</body></html>') as html
from (select b.business_id as id, b.name, b.city, b.postal_code, b.national_phone, p.p_name as words, SERIES(1, 2) as attempt,
  case b.business_id % 3 when 0 then concat('https://www.negocio', cast(b.business_id as varchar(12)), '.es/') when 1 then concat('https://tienda.negocio', cast(b.business_id as varchar(12)), '.es/') else concat('https://pelu', cast(b.business_id as varchar(12)), '.wixsite.com/') end as home
  from fx_business b join part p on p.p_partkey = b.business_id) h
union all
select case when g.k = 0 then 'https://guia-local.es/' else concat('https://www.otro', cast(g.k as varchar(4)), '.co.uk/') end, 1, case when g.k = 0 then 'https://guia-local.es/es' else concat('https://www.otro', cast(g.k as varchar(4)), '.co.uk/') end, case when g.k % 7 = 3 then 500 else 200 end, 'text/html', null,
 concat('<html><head><title>Todos los bares</title></head><body><h1>Customer</h1><p>', n.n_name, '</p></body></html>')
from (select n_nationkey as k, n_name from nation) g join nation n on n.n_nationkey = g.k
"""

FIXTURES["fx_page"] = """
select cast((p.page_id - p.page_id % 3) / 3 as bigint) as business_id, p.page_id % 3 as seq, p.page_id, p.url,
  case when p.page_id % 29 = 3 then concat('<!DOCTYPE html><html><head><title>App</title></head><body><div id="root"></div><script src="/app.js?v=', cast(p.page_id as varchar(12)), '"></script><noscript>Please enable JavaScript</noscript></body></html>')
    else replace(replace(p.html, '</head>', concat(h.extra, '</head>')), '<article>', concat(b.extra, '<article>')) end as html
from pages p
join (values
 (0, ''),
 (1, '<meta name="viewport" content="width=device-width, initial-scale=1"><meta name="description" content=" Peluquer&iacute;a en Sevilla "><link rel="icon" href="/favicon.png">'),
 (2, '<meta name="viewport" content="width=1024"><meta name="generator" content="WordPress 5.8.1"><script src="/wp-includes/js/jquery/jquery.min.js?ver=1.12.4"></script>'),
 (3, '<meta content="NOINDEX, follow" name="robots"><meta name="viewport" content="width=device-width, user-scalable=no"><meta name="generator" content="Joomla! 2.5">'),
 (4, '<link rel="stylesheet" href="http://cdn.example.org/a.css"><script type="application/ld+json">{"@type":"Restaurant","telephone":"+34 954 12 34 56","email":"mailto:info@casapepe.es","address":{"@type":"PostalAddress","postalCode":"41003","streetAddress":"Calle Feria 12"},"openingHoursSpecification":[{"dayOfWeek":["Monday","https://schema.org/Tuesday"],"opens":"09:00:00","closes":"20:30"}],"sameAs":["https://www.instagram.com/casapepe/"]}</script>'),
 (5, '<script type="application/ld+json">{"@graph":[{"@type":["Organization","Thing"],"telephone":["954 00 11 22","+34 600 111 222"],"openingHours":["Mo-Fr 10:00-14:00,17:00-20:00","Sa 10:00-14:00"]},{"@type":"WebSite","name":"x"}]}</script>'),
 (6, '<meta name="viewport" content="width=device-width, maximum-scale=1.0"><script src="https://cdn.example.com/jquery-3.6.0.min.js"></script>')
) as h(i, extra) on h.i = p.page_id % 7
join (values
 (0, ''),
 (1, '<a href="tel:+34954123456">Llamar</a><a href="https://wa.me/34600111222">WhatsApp</a><a href="/contacto">Contacto</a>'),
 (2, '<p>Escr&iacute;benos a hola@tienda.es o llama al 954 12 34 56. Calle Sierpes 5, 41004 Sevilla. Lunes a viernes 10:00 - 20:00.</p><a href="mailto:Ventas@tienda.es?subject=x">Email</a>'),
 (3, '<form action="/x"><input type="hidden" name="h"><label for="n">Nombre</label><input id="n" name="nombre"><input name="email" type="email"><label>Tel <input name="t"></label><textarea name="m"></textarea><input type="submit" value="Pedir cita"></form>'),
 (4, '<img src="/a.jpg"><img src="https://images.unsplash.com/1.jpg"><img src="http://static.pexels.com/2.jpg"><img data-src="https://cdn.pixabay.com/3.jpg" alt="c">'),
 (5, '<a href="https://www.thefork.es/r/1">Reservar mesa</a><iframe src="https://www.google.com/maps/embed?x=1"></iframe><a href="/cita-previa">Cita</a>'),
 (6, '<a href="/carta.pdf">Nuestra carta</a> <a href="https://www.facebook.com/bar1?ref=x">FB</a><a href="https://www.facebook.com/sharer.php?u=1">share</a><a href="https://m.youtube.com/c/bar">YT</a>'),
 (7, '<p>Debido a la pandemia, aforo reducido. Men&uacute; de Navidad 2019. Fundado desde 2001. &copy; 2015-2018 Bar. Cerrado temporalmente.</p>'),
 (8, '<center><font size="2">x</font></center><table width="100%"><tr><td><table><tr><td>a</td></tr></table></td></tr></table><embed src="intro.swf">'),
 (9, '<p>Pr&oacute;ximamente nueva web. Lorem ipsum &#8211; dolor.</p><button></button><a href="/vacio"></a><a href="/nosotros">Qui&eacute;nes somos</a>'),
 (10, '<span data-cfemail="4a23242c250a282b3864393d">x</span><a href="https://x.com/barfoo/">X</a><a href="//www.instagram.com/bar.foo/">IG</a><a href="https://www.instagram.com/p/abc">post</a>')
) as b(i, extra) on b.i = p.page_id % 11
"""

FIXTURES["fx_capture"] = """
select p.business_id, a.attempt, a.purpose, p.page_id, p.url as requested_url,
  case when a.purpose = 'other_protocol' then replace(p.url, 'https:', 'http:') when p.page_id % 37 = 0 then 'https://www.facebook.com/x' when p.page_id % 41 = 0 then 'https://park.sedo.com/x' when p.page_id % 43 = 0 then 'https://otro.example.es/' else p.url end as url,
  case when p.page_id % 13 = 0 then 404 when p.page_id % 17 = 0 then 503 when p.page_id % 19 = 0 then 403 when p.page_id % 47 = 0 then 302 + 100 * (p.page_id % 2) else 200 end as status,
  case when a.purpose = 'first' then case p.page_id % 23 when 0 then 'DNS_NOT_FOUND' when 1 then 'TIMEOUT' when 2 then 'TLS_ERROR' when 3 then 'SSRF_BLOCKED' when 4 then 'CONNECTION_REFUSED' when 5 then 'UNKNOWN' else null end
    else case when (p.page_id + a.attempt) % 3 = 0 then 'TIMEOUT' when (p.page_id + a.attempt) % 5 = 0 then 'TLS_ERROR' else null end end as error_code,
  case p.page_id % 5 when 0 then 'certificate has expired: CERT_HAS_EXPIRED' when 1 then 'UNABLE_TO_VERIFY_LEAF_SIGNATURE' when 2 then 'DEPTH_ZERO_SELF_SIGNED_CERT' when 3 then 'ERR_TLS_CERT_ALTNAME_INVALID' else 'handshake failure' end as error_detail,
  case when p.page_id % 31 = 0 then 'application/pdf' when p.page_id % 7 = 0 then 'TEXT/HTML; charset=utf-8' else 'text/html' end as content_type,
  p.page_id % 90 as tls_days_left, (p.page_id * 271) % 8000 as total_ms, p.page_id % 6 as redirects,
  case p.page_id % 3 when 0 then true when 1 then false else null end as http_redirects_https,
  case p.page_id % 4 when 0 then true else false end as https_available,
  p.page_id % 25 = 1 as horizontal_overflow, p.page_id % 8 as console_errors, p.page_id % 6 <> 0 as favicon_ok,
  p.page_id % 59 <> 0 as robots_allowed,
  case when p.page_id % 61 = 0 then '' when p.page_id % 19 = 0 and p.page_id % 2 = 0 then concat('<html>Just a moment', p.html) else p.html end as html
from (select business_id, page_id, url, html, SERIES(1, 5) as attempt from fx_page) p
join (values (1,'first'),(2,'insecure'),(3,'slow'),(4,'other_protocol'),(5,'www')) as a(attempt, purpose) on a.attempt = p.attempt
where p.attempt = 1 or p.page_id % 23 < 6
"""

FIXTURES["fx_probe"] = """
select cast((p.page_id - p.page_id % 3) / 3 as bigint) as business_id, p.page_id, p.k, concat('https://t', cast(p.k as varchar(4)), '.example.com/x', cast(p.page_id as varchar(12))) as target_url,
 case p.k % 4 when 0 then 'link' when 1 then 'image' when 2 then 'resource' else 'domain' end as target_kind,
 p.k % 8 = 2 as is_script,
 case when (p.page_id + p.k) % 7 = 0 then 404 when (p.page_id + p.k) % 11 = 0 then 503 when (p.page_id + p.k) % 17 = 0 then 500 when (p.page_id + p.k) % 13 = 0 then null else 200 end as status,
 case when (p.page_id + p.k) % 13 = 0 and (p.page_id + p.k) % 17 <> 0 and (p.page_id + p.k) % 7 <> 0 and (p.page_id + p.k) % 11 <> 0 then 'DNS_NOT_FOUND' end as error, (p.page_id * 7919 + p.k * 104729) % 2000000 as bytes
from (select page_id, SERIES(0, 15) as k from pages) p
"""

FIXTURES["fx_robots"] = """
select p.page_id as site_id, p.url,
  concat(r.body, chr(10), 'Disallow: /p', cast(p.page_id % 9 as varchar(2)), chr(10), 'Sitemap: https://', cast(p.page_id as varchar(12)), '.example.com/sm.xml') as content,
  concat(t.path, cast(p.page_id % 7 as varchar(2))) as path
from pages p
join (values (0, concat('User-agent: *', chr(13), chr(10), 'Disallow: /fr', chr(10), 'Allow: /fr/public # note')),
 (1, concat('User-agent: otherbot', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'Disallow: /*.php$')),
 (2, concat('# comment', chr(10), 'USER-AGENT: SiteCheck', chr(10), 'User-agent: foo', chr(10), 'Disallow: /en', chr(10), 'Allow: /en', chr(10), 'User-agent: *', chr(10), 'Disallow: /')),
 (3, concat('no colon line', chr(10), 'Disallow: /orphan', chr(10), 'User-agent: *', chr(10), 'Disallow:', chr(10), 'Crawl-delay: 3', chr(10), 'Disallow: /p*x')),
 (4, concat('User-agent: *', chr(10), 'Allow: /', chr(10), 'Disallow: /fr/p'))) as r(i, body) on r.i = p.page_id % 5
join (values (0, '/fr/public/'), (1, '/en/'), (2, '/p'), (3, '/index.php?x='), (4, '/orphan'), (5, '/p1/x')) as t(i, path) on t.i = p.page_id % 6
"""

FIXTURES["fx_site_robots"] = """
select s.business_id, concat(r.body, chr(10), 'Disallow: /', case s.business_id % 4 when 0 then 'de' when 1 then 'the' when 2 then 'in$' else 'er*n' end) as content
from (select distinct business_id from fx_page) s
join (values (0, concat('User-agent: *', chr(10), 'Disallow: /cont', chr(10), 'Allow: /contacto$')), (1, concat('User-agent: *', chr(10), 'Disallow: /*previa', chr(10), 'Disallow: /e')),
 (2, concat('User-agent: sitecheck', chr(10), 'Disallow: /', chr(10), 'Allow: /n', chr(10), 'Allow: /c*a')), (3, concat('User-agent: other', chr(10), 'Disallow: /', chr(10), 'User-agent: *', chr(10), 'Allow: /x')),
 (4, concat('User-agent: *', chr(10), 'Disallow: /cita-previa', chr(10), 'Allow: /cita-previa')), (5, 'Disallow: /orphan')) as r(i, body) on r.i = s.business_id % 6
"""

FIXTURES["fx_lead_text"] = """
select d.doc_id, d.text, d.lang, concat(case d.doc_id % 6 when 0 then 'Menú de Navidad 2018 y oferta de verano 2021. ' when 1 then 'Copyright 2012-2016. Abierto desde 1999. ' when 2 then 'Calle Sierpes 12, 41004 Sevilla; tel. 954 123 456 y +44 20 7946 0958. ' when 3 then 'COVID-19: aforo limitado. Lunes a viernes 09:00 - 14:00. ' when 4 then 'Este dominio está en venta. ' else 'Próximamente: hola@Bar-Pepe.es, user@test.com ' end, d.text) as ad_text
from documents d
"""

FIXTURES["fx_named_text"] = """
select t.doc_id, t.ad_text, concat('Menú y oferta en Sevilla ', coalesce(c.c_name, '')) as name
from fx_lead_text t left join customer c on c.c_custkey = t.doc_id % (select count(*) from customer)
"""

FIXTURES["fx_area"] = """
select n_nationkey as area_id, 37.30D + n_nationkey / 100.0D as lat, -6.05D + n_nationkey / 200.0D as lng, 1500.0D + 700.0D * n_nationkey as radius_m from nation
"""

FIXTURES["fx_place_hit"] = """
select c_custkey % 12 as query_idx, ((c_custkey - c_custkey % 12) / 12) % 3 as tile_idx, cast((c_custkey - c_custkey % 36) / 36 as bigint) + 1 as rank,
 case when c_custkey % 7 = 0 then c_custkey + 1 else c_custkey end as place_id from customer
"""

FIXTURES["fx_scan_hit"] = """
select scan_id, query_idx, tile_idx, cast(row_number() over (partition by scan_id, query_idx, tile_idx order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as bigint) as rank, place_id, place_id % 10 <> 3 as inside from (
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when l_orderkey % 3 = 0 then 0 else l_orderkey % 9 end as bigint) as scan_id, cast(l_partkey % (3 + l_orderkey % 5) as bigint) as query_idx,
  cast(l_suppkey % 5 as bigint) as tile_idx, cast((l_partkey * 31 + l_suppkey) % 5000 as bigint) as place_id from lineitem) h
"""

FIXTURES["fx_nested_ld"] = """
select page_id, concat('[', repeat('{"@type":"Shell","@graph":[[', cast(page_id % 12 as int)), '{"@type":"Store","name":"', url, '","telephone":"95', cast(1000000 + page_id as varchar(12)),
 '"},{"name":"untyped","@graph":{"@type":["Event","Thing"],"name":"', cast(page_id as varchar(12)), '"}}', repeat(']]}', cast(page_id % 12 as int)), ']') as body from pages
"""

FIXTURES["fx_weight"] = """
select kind, key, place, cast(points as double) as points from (values ('severity','CRITICAL',0,9),('severity','HIGH',1,11),('severity','MEDIUM',2,2.5),('severity','LOW',3,1),('severity','INFO',4,0),
 ('cap','WEB_FUNCIONAL_CON_PROBLEMAS',0,28),('cap','WEB_ACEPTABLE',1,10),('status','SIN_WEB',0,33),('contact','phone',0,9),('level','HIGH',0,52),
 ('consistency','PHONE_MISMATCH',3,7),('consistency','ADDRESS_MISMATCH',1,8),('consistency','HOURS_MISMATCH',2,5),('consistency','STATUS_CONFLICT',0,9),('consistency','STALE_COVID_NOTICE',4,5),
 ('consistency','OLD_DATED_CONTENT',5,4),('consistency','GOOGLE_LISTING_MISSING_WEBSITE',6,0),('consistency','DEAD_EXTERNAL_DOMAINS',7,3),('consistency','SITEMAP_STALE',8,2),
 ('consistency','PROVIDER_MISSING_PHONE',9,2),('consistency','WEBSITE_HOURS_CONTRADICTORY',10,2),('consistency','OLD_COPYRIGHT',11,6)) as w(kind, key, place, points)
"""

FIXTURES["fx_typed"] = """
select p_partkey as id, t.types, case when p_partkey % 11 = 0 then 'gimnasios' when p_partkey % 11 = 1 then 'no-existe' else null end as hint,
 t.tag_key, t.tag_value, t.request, p_partkey % 13 = 0 as all_categories
from part join (values (0,'store,point_of_interest','shop','clothes','restaurantes,tiendas'),(1,'bar,restaurant','amenity','bar','floristas'),(2,'dentist','healthcare','clinic','clinicas,floristas,gimnasios'),
 (3,'unknown','amenity','bank','x,y'),(4,'school,store','amenity','veterinary',''),(5,'lodging,bar','tourism','hotel','todas'),(6,'car_wash','shop','car_parts','talleres'),(7,'gym','leisure','sports_centre_old','gimnasios')) as t(i, types, tag_key, tag_value, request) on t.i = p_partkey % 8
"""

FIXTURES["fx_note"] = """
select l_orderkey * 8 + l_linenumber as note_id, l_orderkey % (select count(*) from customer) as business_id, max(l_shipdate) as created_at, max(l_returnflag) as body from lineitem group by l_orderkey, l_linenumber
"""

FIXTURES["fx_job"] = """
select l_orderkey * 8 + l_linenumber as job_id, l_orderkey as scan_id, (l_orderkey * 7 + l_linenumber * 13) % (select count(*) from customer) as business_id,
 case (l_orderkey + l_linenumber) % 5 when 0 then 'QUEUED' when 1 then 'RUNNING' when 2 then 'FAILED' when 3 then 'COMPLETED' else 'CANCELLED' end as status,
 timestamp '2024-01-14 00:00:00' + interval '1' minute * (l_orderkey % 3000) as finished_at from lineitem
"""

FIXTURES["fx_osm"] = """
select p_partkey as id, case p_partkey % 3 when 0 then 'node' when 1 then 'way' else 'relation' end as type,
 case when p_partkey % 19 = 0 then null else 37.39D + (p_partkey % 500) / 10000.0D end as lat, case when p_partkey % 19 = 0 then null else -5.99D + (p_partkey % 300) / 10000.0D end as lon,
 concat(case when p_partkey % 10 = 9 then '' else concat('name=', p_name, '|') end, t.tags, '|addr:housenumber=', cast(p_partkey % 50 as varchar(4))) as tags_text
from part join (values (0,'amenity=bar|addr:street=Calle Sol|addr:city=Sevilla|phone=954 1;954 2|website= http://bar.es ; x'),
 (1,'shop=car_repair|addr:postcode=41001|contact:phone=+34 600|contact:website=taller.es|opening_hours=Mo-Fr 09:00-14:00'),
 (2,'healthcare=clinic|amenity=clinic|addr:province=Sevilla|addr:state=Andalucia|contact:mobile=611|email=a@b.es;c@d.es|contact:instagram=@clin'),
 (3,'office=lawyer|disused=yes|url=http://abogado.es'),(4,'craft=car_repair|disused:shop=yes|addr:street=Plaza Luna|addr:postcode=41002|addr:city=Sevilla')) as t(i, tags) on t.i = p_partkey % 5
"""

FIXTURES["fx_hours_text"] = """
select c_custkey as business_id, concat(t.raw, case when c_custkey % 4 = 0 then '; PH off' when c_custkey % 9 = 0 then '; Su off' else '' end) as raw
from customer join (values (0,'24/7'),(1,'Mo-Fr 09:00-14:00,17:00-20:00; Sa 10:00-14:00'),(2,'Sa-Tu 08:00-23:00'),(3,'10:00-14:00, 16:00-20:00'),(4,'Mo,We,Fr 09:00-13:00;Th closed'),
 (5,'Mo-Fr 9-14'),(6,'Xx 09:00-10:00'),(7,'mo-su 00:00-24:00'),(8,'Tu off; We-We 12:00-13:00')) as t(i, raw) on t.i = c_custkey % 9
"""

FIXTURES["fx_place_json"] = """
select c_custkey as business_id, concat('{"id":"g', cast(c_custkey as varchar(12)), '","displayName":{"text":"', c_name, '"},"types":["bar","cafe"],"primaryType":"bar",',
 '"addressComponents":[{"longText":"Calle Feria","shortText":"F","types":["route"]},', case when c_custkey % 2 = 0 then concat('{"longText":"', cast(c_custkey % 80 as varchar(4)), '","shortText":"n","types":["street_number"]},') else '' end,
 case c_custkey % 3 when 0 then '{"longText":"Sevilla","shortText":"S","types":["political","locality"]},' when 1 then '{"longText":"Dos Hermanas","shortText":"D","types":["administrative_area_level_3"]},{"longText":"Bermejales","shortText":"B","types":["postal_town"]},' else '{"longText":"Andalucia","shortText":"A","types":["administrative_area_level_1"]},' end,
 '{"longText":"Spain","shortText":"ES","types":["country","political"]}],"rating":', cast(c_custkey % 5 as varchar(2)), ',"regularOpeningHours":{"periods":[',
 case c_custkey % 4 when 0 then '{"open":{"day":0,"hour":0,"minute":0}}' when 1 then '{"open":{"day":1,"hour":9},"close":{"day":1,"hour":14,"minute":5}},{"open":{"day":2,"hour":17,"minute":30}}' when 2 then '{"close":{"day":3,"hour":1}},{"open":{"day":6,"hour":8},"close":{"day":0,"hour":2}}' else '' end,
 ']},"reviews":[{"rating":5,"text":{"text":"  "}},{"rating":', cast(c_custkey % 5 as varchar(2)), ',"originalText":{"text":"Bien"},"text":{"text":"Good"}}]}') as body
from customer
"""

FIXTURES["fx_url"] = """
select c_custkey as url_id, case c_custkey % 9 when 0 then concat('https://', d.domain, '/maps/x', cast(c_custkey % 40 as varchar(4))) when 1 then concat('HTTP://www.', upper(d.domain), '/Perfil?utm=', cast(c_custkey as varchar(12)), '#top')
  when 2 then concat('  m.', d.domain, '/u/', cast(c_custkey as varchar(12)), '/ ') when 3 then concat('https://user:pw@bar', cast(c_custkey as varchar(12)), '.com.es:8443/a b/ñ?q=1') when 4 then concat('ftp://', d.domain, '/x')
  when 5 then concat('https://tienda', cast(c_custkey as varchar(12)), '.co.uk') when 6 then concat('http://x.', d.domain, '.evil.com/') when 7 then 'http://bad host/' else concat('https://', d.domain, '/send?phone=34', cast(c_custkey as varchar(12))) end as url
from customer join (values __PLATFORMS__) as d(i, domain) on d.i = c_custkey % __N__
"""

FIXTURES["fx_phone"] = """
select c_custkey as id, case c_custkey % 9 when 0 then concat('+34 9', lpad(cast((c_custkey * 7919) % 100000000 as varchar(8)), 8, '0')) when 1 then concat('tel:0034 6', lpad(cast(c_custkey as varchar(8)), 8, '1')) when 2 then concat('(95) ', lpad(cast(c_custkey as varchar(7)), 7, '2'))
  when 3 then concat('020 7', lpad(cast(c_custkey % 1000 as varchar(3)), 3, '0'), ' 0958') when 4 then concat('+1 (212) 555-', lpad(cast(c_custkey % 10000 as varchar(4)), 4, '0')) when 5 then cast(c_custkey as varchar(12)) when 6 then concat('+999', cast(c_custkey as varchar(12)))
  when 7 then concat('954.', lpad(cast(c_custkey % 1000 as varchar(3)), 3, '0'), '.456') else concat('+33 0', lpad(cast(c_custkey % 1000 as varchar(3)), 3, '1'), '23456') end as raw,
 case when c_custkey % 9 = 3 then 'GB' when c_custkey % 2 = 0 then 'es' else 'ES' end as country
from customer
"""

_DOMAINS = list(dict.fromkeys(d for _, d, _, _ in flat_platforms()))
FIXTURES["fx_url"] = (
    FIXTURES["fx_url"]
    .replace("__PLATFORMS__", ", ".join(f"({i},'{d}')" for i, d in enumerate(_DOMAINS)))
    .replace("__N__", str(len(_DOMAINS)))
)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Readers of the supplied tables; nothing is read until used."""
    return _Tables(spark, sf_dir)


class _Tables(dict):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            text = FIXTURES[name]
            used = {n: self[n] for n in _names_in(text)}
            text = text.replace("{", "{{").replace("}", "}}")
            for n in used:
                text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
            text = re.sub(r"SERIES\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", text)
            df = self.spark.sql(text, **used)
        else:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in SPREAD_TABLES:
                df = spread(df)
        self[name] = df
        return df


def _names_in(text: str) -> list[str]:
    known = set(BASE_TABLES) | set(FIXTURES)
    found = re.findall(r"\b(?:from|join)\s+([a-z_]+)\b", text)
    return [n for n in dict.fromkeys(found) if n in known]


def ansi_ctes(*names: str) -> str:
    """``with ...`` clause defining the named derivations (and what they need) for the SQL checks."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for inner in _names_in(FIXTURES[name]):
            if inner in FIXTURES:
                add(inner)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    parts = []
    for n in ordered:
        text = re.sub(r"SERIES\((\d+), (\d+)\)", r"unnest(generate_series(\1, \2))", FIXTURES[n])
        text = re.sub(r"(\d+\.\d+)D\b", r"\1::double", text)
        parts.append(f"{n} as ({text.strip()})")
    return "with " + ",\n".join(parts)
