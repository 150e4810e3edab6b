"""URL column builders: parsing, resolving, site identity and platform lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import platforms as PL
from .literals import literal_map
from .text import let, trim_blanks

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _encode(part: Column) -> Column:
    """Percent-encode blanks and non-ASCII characters, leave the rest alone."""
    return let(part, _encoded)


def _encoded(part: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(part, ""),
            lambda ch: F.when(ch == " ", "%20").when(ch.rlike(r"[^\x21-\x7e]"), F.url_encode(ch)).otherwise(ch),
        ),
        "",
    )
    return F.when(part.rlike(r"[^\x21-\x7e]"), encoded).otherwise(part)


def parse(url: Column) -> Column:
    """struct<scheme, host, port, path, query>; NULL when the text is no usable http(s) URL."""
    def build(r: Column) -> Column:
        default = ((r["scheme"] == "http") & (r["port"] == "80")) | ((r["scheme"] == "https") & (r["port"] == "443"))
        ok = r["scheme"].isin("http", "https") & r["host"].rlike(r"^[^\x00-\x20#%/:<>?@\[\\\]^|]+$")
        return F.when(
            ok,
            F.struct(
                r["scheme"].alias("scheme"),
                r["host"].alias("host"),
                F.when(default | (r["port"] == ""), F.lit("")).otherwise(F.concat(F.lit(":"), r["port"])).alias("port"),
                F.when(r["path"] == "", "/").otherwise(_dotless(_encode(r["path"]))).alias("path"),
                _encode(r["query"]).alias("query"),
            ),
        )

    def raw(u: Column) -> Column:
        authority = F.regexp_replace(F.regexp_extract(u, _SPLIT, 2), "^.*@", "")
        return F.struct(
            F.lower(F.regexp_extract(u, _SPLIT, 1)).alias("scheme"),
            F.lower(F.regexp_replace(authority, r":\d*$", "")).alias("host"),
            F.regexp_extract(authority, r":(\d+)$", 1).alias("port"),
            F.regexp_extract(u, _SPLIT, 3).alias("path"),
            F.regexp_extract(u, _SPLIT, 4).alias("query"),
        )

    return let(url, lambda u: let(raw(u), build))


def _dotless(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    return let(path, _dotless_path)


def _dotless_path(path: Column) -> Column:
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(parts, "/")).otherwise(path)


def render(parts: Column) -> Column:
    return let(parts, lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], p["port"], p["path"], p["query"]))


def website_parts(raw: Column) -> Column:
    """Parsed site address, ``http://`` assumed when no scheme is written."""
    def full(s: Column) -> Column:
        return F.when(s.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("http://"), s))

    return let(trim_blanks(raw), lambda s: F.when(s != "", parse(full(s))))


def normalize_website(raw: Column) -> Column:
    return render(website_parts(raw))


def resolve(href: Column, base_parts: Column) -> Column:
    """Absolute form of a link found on the page parsed as ``base_parts``; NULL for fragments, scripts and data."""
    b = base_parts

    def target(h: Column) -> Column:
        origin = F.concat(b["scheme"], F.lit("://"), b["host"], b["port"])
        return (
            F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(b["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, b["path"], h))
            .otherwise(F.concat(origin, F.regexp_replace(b["path"], "[^/]*$", ""), h))
        )

    def absolute(t: Column) -> Column:
        return F.when(
            t.rlike("(?i)^https?://"), F.concat(render(parse(t)), F.regexp_extract(t, "(#.*)$", 1))
        ).otherwise(t)

    return let(
        trim_blanks(href),
        lambda h: F.when(
            (h != "") & ~h.startswith("#") & ~h.rlike("(?i)^(javascript|data):"), let(target(h), absolute)
        ),
    )


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def registrable_domain(host: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(host), r"\.$", ""), r"^www\.", "")

    def shorten(parts: Column) -> Column:
        last_two = F.array_join(F.slice(parts, -2, 2), ".")
        return (
            F.when(F.size(parts) <= 2, F.array_join(parts, "."))
            .when(last_two.isin(PL.TWO_LEVEL_SUFFIXES), F.array_join(F.slice(parts, -3, 3), "."))
            .otherwise(last_two)
        )

    return let(F.split(clean, r"\."), shorten)


def canonical_social(parts: Column) -> Column:
    host = F.regexp_replace(parts["host"], r"^(m|mobile|web|es-es|es-la)\.", "www.")
    return F.regexp_replace(
        F.concat(parts["scheme"], F.lit("://"), host, parts["port"], parts["path"]), "/$", ""
    )


def safe_http(url: Column) -> Column:
    full = F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), url).otherwise(F.concat(F.lit("http://"), url))
    fragment = F.regexp_extract(full, "(#.*)$", 1)
    return F.when(url != "", F.concat(render(parse(trim_blanks(full))), fragment))


def host_label(url: Column) -> Column:
    """Host to display; the text itself when it is no URL, empty for nothing."""
    return F.when(url.isNull() | (url == ""), "").otherwise(
        F.coalesce(bare_host(parse(trim_blanks(url))["host"]), url)
    )


def host_suffixes(host: Column) -> Column:
    return let(
        F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\."),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        ),
    )


def platform(host: Column, path: Column, rules: list[tuple[int, str, str, str]] | None = None) -> Column:
    """struct<seq, kind, label> of the first platform rule the host falls under, else NULL.

    The rule table is a constant map, looked up once per host suffix: a projection, no join and no shuffle.
    """
    rules = rules or PL.flat_platforms()
    first: dict[str, dict] = {}
    for seq, domain, kind, label in rules:
        first.setdefault(domain, {"seq": seq, "kind": kind, "label": label})
    table = literal_map(first)
    under_maps = path.startswith("/maps")
    hits = F.filter(
        F.transform(
            host_suffixes(host),
            lambda s: F.when((s != PL.MAPS_ONLY_DOMAIN) | under_maps, table[s]),
        ),
        lambda m: m.isNotNull(),
    )
    return F.array_min(hits)


def is_not_own_site(kind: Column) -> Column:
    return F.coalesce(~kind.isin(PL.OWN_SITE_KINDS), F.lit(False))


def contact_type(parts: Column) -> Column:
    """Contact type a link stands for, NULL when the host is no known platform."""
    by_label = literal_map(PL.CONTACT_TYPE_BY_LABEL)

    def kind(u: Column, p: Column) -> Column:
        return F.when(
            p.isNotNull(),
            F.when((p["kind"] == "MESSAGING") & u["host"].rlike(r"whatsapp|wa\.me|wa\.link"), "WHATSAPP")
            .when(p["kind"].isin("BOOKING_PLATFORM", "DELIVERY"), "BOOKING_PAGE")
            .otherwise(F.coalesce(by_label[p["label"]], F.lit("OTHER"))),
        )

    return let(parts, lambda u: let(platform(u["host"], u["path"]), lambda p: kind(u, p)))


def social_profile(parts: Column) -> Column:
    """Type of business profile a page link points to, NULL for share buttons, posts and other pages."""
    h, p = parts["host"], parts["path"]
    return (
        F.when(
            h.rlike(r"(^|\.)instagram\.com$")
            & p.rlike(r"^/[A-Za-z0-9._]{2,30}/?$")
            & ~p.rlike(r"^/(p|reel|reels|explore|accounts|stories|direct)(?![A-Za-z0-9_])"),
            "INSTAGRAM",
        )
        .when(
            h.rlike(r"(^|\.)(facebook\.com|fb\.com)$")
            & (F.length(p) > 1)
            & ~p.rlike(r"(sharer|share\.php|/dialog/|/plugins/|/tr(?![A-Za-z0-9_])|/login|/policies|/help)"),
            "FACEBOOK",
        )
        .when(h.rlike(r"(^|\.)tiktok\.com$") & p.rlike("^/@"), "TIKTOK")
        .when(h.rlike(r"(^|\.)linkedin\.com$") & p.rlike("^/(company|in|school)/"), "LINKEDIN")
        .when(
            h.rlike(r"(^|\.)(twitter\.com|x\.com)$")
            & p.rlike("^/[A-Za-z0-9_]{2,15}/?$")
            & ~p.rlike("^/(intent|share|home|search)(?![A-Za-z0-9_])"),
            "X",
        )
        .when(h.rlike(r"(^|\.)youtube\.com$") & p.rlike("^/(channel|c|user|@)"), "YOUTUBE")
    )


def is_chat_link(parts: Column) -> Column:
    h, p = parts["host"], parts["path"]
    return h.rlike(r"(^|\.)(wa\.me|whatsapp\.com)$") & (
        ~p.rlike("/(send)?/?$") | parts["query"].rlike(r"[?&]phone=[^&]+") | p.rlike(r"^/\d{6,}")
    )


def same_as_type(parts: Column) -> Column:
    """Profile type of a declared ``sameAs`` address."""
    h = parts["host"]
    return (
        F.when(h.rlike(r"instagram\.com$"), "INSTAGRAM")
        .when(h.rlike(r"facebook\.com$"), "FACEBOOK")
        .when(h.rlike(r"tiktok\.com$"), "TIKTOK")
        .when(h.rlike(r"linkedin\.com$"), "LINKEDIN")
        .when(h.rlike(r"(twitter|x)\.com$"), "X")
        .when(h.rlike(r"youtube\.com$"), "YOUTUBE")
    )
