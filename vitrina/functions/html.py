"""HTML as columns: tags, attributes, visible text, links, forms and structured data.

A page becomes an array of its tags plus a few texts, and every fact is an expression over those arrays, so parsing
is a projection inside the JVM: no Python per page, no shuffle.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import patterns as P
from ..rules.platforms import BOOKING_HOSTS
from ..rules.regex import java
from . import hours as H
from . import text as T
from . import url as U
from .literals import literal_array, lookup

WHOLE = 2_147_483_647  # length of the rest of a text

_ATTRS = r"""((?:[^'">]++|"[^"]*+"|'[^']*+')*+)"""
_TAG = rf"</?[a-zA-Z]{_ATTRS}>"
# --- fixed values: element names by role -----------------------------------------------------
HIDDEN_ELEMENTS = ["script", "style", "noscript", "svg", "template", "iframe"]
BLOCK_ELEMENTS = [
    "p", "div", "li", "td", "th", "a", "h1", "h2", "h3", "h4", "h5", "h6", "section", "footer", "header", "address",
    "dd", "dt",
]
SELF_CLOSING_BLOCKS = ["br", "p", "li", "td", "th", "dd", "dt"]
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
]
SHELL_ROOTS = r"""(?i)<[^>]*(\bid\s*=\s*["']?(root|app|__next|__nuxt|___gatsby)["'\s>]|\bdata-reactroot\b)|<app-root\b"""
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
# --- end of fixed values ---------------------------------------------------------------------


# Decoded characters that would read as markup wait as private-use characters until the tags are cut out.
_MARKUP, _WAITING = "<>\"'", "\ue000\ue001\ue002\ue003"


def decode_references(c: Column) -> Column:
    """Character references of a whole document decoded once, left to right."""
    named = {name: chr(cp) for name, cp in name2codepoint.items()} | {"apos": "'"}

    def char_of(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def decoded(ref: Column) -> Column:
        plain = (
            F.when(ref.rlike("^#[0-9]"), char_of(F.substring(ref, 2, 9).try_cast("bigint")))
            .when(ref.rlike("^#[xX]"), char_of(F.conv(F.substring(ref, 3, 9), 16, 10).try_cast("bigint")))
            .otherwise(lookup(named, ref))
        )
        return F.translate(plain, _MARKUP, _WAITING)

    def piece(p: Column, i: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        whole = F.concat(F.lit("&"), p)
        return F.when(i == 0, p).otherwise(T.let(
            ref,
            lambda r: F.when(r == "", whole).otherwise(
                F.coalesce(F.concat(decoded(r), F.substring(p, F.length(r) + 2, F.length(p))), whole)),
        ))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), piece), "")).otherwise(c)


def _settled(c: Column) -> Column:
    return F.translate(c, _WAITING, _MARKUP)


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")


def without_code(html: Column) -> Column:
    """Script and style bodies emptied so that nothing inside them looks like a tag."""
    out = html
    for name in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)(<{name}\b{_ATTRS}>).*?</{name}\s*>", f"$1</{name}>")
    return out


def visible_text(html: Column) -> Column:
    """Body text without hidden elements, blocks separated by one space."""
    out = F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)</body\s*>.*$", "")
    out = F.regexp_replace(out, rf"(?is)<({'|'.join(HIDDEN_ELEMENTS)})\b{_ATTRS}>.*?(</\1\s*>|$)", "")
    out = F.regexp_replace(out, rf"(?i)</(?:{'|'.join(BLOCK_ELEMENTS)})\s*>|<(?:{'|'.join(SELF_CLOSING_BLOCKS)})\b[^>]*>", " ")
    return T.squeeze(_settled(F.regexp_replace(out, _TAG, "")))


def inner_text(fragment: Column) -> Column:
    return T.squeeze(_settled(F.regexp_replace(fragment, _TAG, "")))


def tags(clean: Column) -> Column:
    """array<struct<name, closing, raw>> in document order."""
    return F.transform(
        F.regexp_extract_all(clean, F.lit(_TAG), F.lit(0)),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"),
            t.startswith("</").alias("closing"),
            t.alias("raw"),
        ),
    )


def attr(raw: Column, name: str) -> Column:
    """Attribute value of a tag text, NULL when absent, empty when it has none."""
    p = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(raw, p, i) for i in (1, 2, 3)])
    return F.when(raw.rlike(rf"""(?i)[\s"'/]{name}(?=[\s=/>])"""), _settled(value))


def opening(all_tags: Column, *names: str) -> Column:
    return F.filter(all_tags, lambda t: t["name"].isin(*names) & ~t["closing"])


def _blocks(html: Column, name: str) -> Column:
    """array<struct<head, body>>: attribute text (with its tag) and inner HTML of each element."""
    p = rf"(?is)<{name}\b{_ATTRS}>(.*?)</{name}\s*>"
    return F.zip_with(
        F.regexp_extract_all(html, F.lit(p), F.lit(1)),
        F.regexp_extract_all(html, F.lit(p), F.lit(2)),
        lambda a, b: F.struct(F.concat(F.lit(f"<{name}"), a, F.lit(">")).alias("head"), b.alias("body")),
    )


def _not_blank(c: Column) -> Column:
    return F.when(c != "", c)


def _urls(all_tags: Column, name: str, base: Column) -> Column:
    return F.filter(
        F.transform(opening(all_tags, name), lambda t: U.resolve(attr(t["raw"], "src"), base)), lambda u: u.isNotNull()
    )


def _meta(all_tags: Column, name: str) -> Column:
    """``content`` of the first meta tag with that name."""
    found = F.filter(opening(all_tags, "meta"), lambda t: F.lower(F.coalesce(attr(t["raw"], "name"), F.lit(""))) == name)
    return attr(F.get(found, F.lit(0))["raw"], "content")


def json_ld(html: Column) -> Column:
    """array<variant> of the page's valid JSON-LD documents."""
    ld = F.filter(
        _blocks(html, "script"),
        lambda s: F.coalesce(F.lower(F.trim(attr(s["head"], "type"))) == "application/ld+json", F.lit(False)),
    )
    return F.filter(F.transform(ld, lambda s: F.try_parse_json(s["body"])), lambda v: v.isNotNull())


def _as_list(v: Column, path: str = "$") -> Column:
    """A variant that may be one value or a list, as array<variant>."""
    one = F.try_variant_get(v, path, "variant")
    many = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(many, F.when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)), F.array().cast("array<variant>"))


def _strings(v: Column, path: str) -> Column:
    kept = F.filter(_as_list(v, path), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(kept, lambda x: F.variant_get(x, "$", "string"))


def ld_nodes(documents: Column, depth: int | None = None) -> Column:
    """Typed nodes of all documents in page order, a node before those of its own ``@graph``.

    Lists and graphs are opened level by level until nothing is left to open. A document has no more levels than it has brackets
    and graphs, so that many rounds are run over it. ``depth``, where given, is the number of levels below the document that count.
    """
    rounds = lambda v: F.regexp_count(F.to_json(v), F.lit(r'\[|"@graph"'))
    most = rounds if depth is None else lambda v: F.least(rounds(v), F.lit(depth))
    return F.flatten(F.transform(documents, lambda v: _opened(v, most(v))))


def _opened(document: Column, rounds: Column) -> Column:
    """The typed nodes reached from one document within ``rounds`` levels."""
    kind = "array<struct<at: array<int>, v: variant>>"

    def place(v: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), v.alias("v"))

    def inside(x: Column) -> Column:
        graph = F.try_variant_get(x["v"], "$['@graph']", "variant")
        members = F.coalesce(
            F.try_variant_get(x["v"], "$", "array<variant>"),
            F.when(graph.isNotNull() & ~F.is_variant_null(graph), F.array(graph)),
            F.array().cast("array<variant>"))
        return F.transform(members, lambda v, i: place(v, F.concat(x["at"], F.array(i))))

    def step(done: Column) -> Column:
        front = F.flatten(F.transform(done["front"], inside))
        return T.let(front, lambda f: F.struct(f.alias("front"), F.concat(done["seen"], f).alias("seen")))

    top = F.array(place(document, F.array().cast("array<int>"))).cast(kind)
    every = F.aggregate(
        F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")),
        F.struct(top.alias("front"), top.alias("seen")),
        lambda done, _: F.when(F.size(done["front"]) > 0, step(done)).otherwise(done),
        lambda done: done["seen"])
    typed = F.filter(every, lambda x: F.try_variant_get(x["v"], "$['@type']", "variant").isNotNull())
    ordered = F.array_sort(typed, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return F.transform(ordered, lambda x: x["v"])


def schema_facts(documents: Column) -> Column:
    """struct of business facts declared in JSON-LD."""
    return T.let(ld_nodes(documents), _node_facts)


def _node_facts(nodes: Column) -> Column:
    every = lambda path: F.array_distinct(F.flatten(F.transform(nodes, lambda n: _strings(n, path))))
    addresses = F.flatten(F.transform(nodes, lambda n: _as_list(n, "$.address")))

    def of_address(path: str, *kinds: str) -> Column:
        values = F.filter(
            F.transform(addresses, lambda a: F.try_variant_get(a, path, "variant")),
            lambda v: v.isNotNull() & F.schema_of_variant(v).isin(*kinds),
        )
        return F.array_distinct(F.transform(values, lambda v: F.variant_get(v, "$", "string")))

    specs = F.flatten(F.transform(nodes, lambda n: _as_list(n, "$.openingHoursSpecification")))
    names = literal_array(WEEKDAYS)

    def spec_periods(s: Column) -> Column:
        opens = F.try_variant_get(s, "$.opens", "string")
        closes = F.try_variant_get(s, "$.closes", "string")
        days = F.transform(
            _strings(s, "$.dayOfWeek"),
            lambda d: (F.array_position(names, F.lower(F.element_at(F.split(d, "/"), -1))) - 1).cast("int"),
        )
        periods = F.transform(
            F.filter(days, lambda d: d >= 0),
            lambda d: F.struct(d.alias("day"), F.substring(opens, 1, 5).alias("open"), F.substring(closes, 1, 5).alias("close")),
        )
        return F.when((opens != "") & (closes != ""), periods).otherwise(F.array().cast("array<struct<day:int,open:string,close:string>>"))

    texts = F.flatten(F.transform(nodes, lambda n: _strings(n, "$.openingHours")))
    hours = F.concat(
        F.flatten(F.transform(specs, spec_periods)),
        F.flatten(F.transform(F.filter(texts, lambda x: F.trim(x) != ""), lambda x: H.text_periods(x)["periods"])),
    )
    return F.struct(
        every("$['@type']").alias("types"),
        every("$.telephone").alias("telephone"),
        F.array_distinct(F.transform(
            F.flatten(F.transform(nodes, lambda n: _strings(n, "$.email"))),
            lambda e: F.regexp_replace(e, "(?i)^mailto:", ""),
        )).alias("email"),
        of_address("$.postalCode", "STRING", "BIGINT").alias("postal_code"),
        of_address("$.streetAddress", "STRING").alias("street_address"),
        hours.alias("opening_hours"),
        every("$.sameAs").alias("same_as"),
    )


def _nested_tables(all_tags: Column) -> Column:
    """Tables inside a table or with a fixed width attribute."""
    only = F.filter(all_tags, lambda t: t["name"] == "table")
    walked = F.aggregate(
        only,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")),
        lambda a, t: F.struct(
            F.when(t["closing"], F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"] + 1).cast("int").alias("depth"),
            (a["n"] + F.when(~t["closing"] & ((a["depth"] > 0) | attr(t["raw"], "width").isNotNull()), 1).otherwise(0)).cast("int").alias("n"),
        ),
    )
    return walked["n"]


def _body_children(all_tags: Column) -> Column:
    """Elements directly under the body, code and style elements aside; a closing tag closes what it encloses."""
    start = F.array_position(F.transform(all_tags, lambda t: F.when((t["name"] == "body") & ~t["closing"], "y").otherwise("n")), "y")
    inside = F.filter(
        F.slice(all_tags, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size(all_tags), F.lit(1))),
        lambda t: ~t["name"].isin("body", "html"),
    )
    skipped = ["script", "noscript", "style", "link"]
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, t: Column) -> Column:
        depth = F.size(a["open"])
        at = depth - F.array_position(F.reverse(a["open"]), t["name"]).cast("int")
        popped = F.when(F.array_contains(a["open"], t["name"]), F.slice(a["open"], 1, at)).otherwise(a["open"])
        leaf = t["name"].isin(VOID_ELEMENTS) | t["raw"].rlike(r"/\s*>$")
        pushed = F.when(leaf, a["open"]).otherwise(F.concat(a["open"], F.array(t["name"])))
        counts = ~t["closing"] & (depth == 0) & ~t["name"].isin(skipped)
        return F.struct(
            F.when(t["closing"], popped).otherwise(pushed).alias("open"),
            (a["n"] + F.when(counts, 1).otherwise(0)).cast("int").alias("n"),
        )

    return F.aggregate(inside, state, step)["n"]


def _first_by(items: Column, field: str) -> Column:
    """Array of structs with later repeats of ``field`` dropped, and those without a value.

    Repeats meet by sorting (value, place), so the work does not grow with the square of the items.
    """
    def firsts(places: Column) -> Column:
        met = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1)["value"] != p["value"]))
        return F.sort_array(F.transform(met, lambda p: p["place"]))

    def kept(xs: Column) -> Column:
        places = F.filter(
            F.transform(xs, lambda x, i: F.struct(x[field].alias("value"), i.alias("place"))), lambda p: p["value"].isNotNull())
        return F.transform(T.let(F.sort_array(places), firsts), lambda i: F.get(xs, i))

    return T.let(items, kept)


def _field_tags(all_tags: Column) -> Column:
    return F.filter(
        opening(all_tags, "input", "textarea", "select"),
        lambda t: (t["name"] != "input")
        | ~F.coalesce(F.lower(attr(t["raw"], "type")).isin("hidden", "submit", "button"), F.lit(False)),
    )


def _forms(bare: Column, all_tags: Column) -> Column:
    label_for = F.transform(opening(all_tags, "label"), lambda t: attr(t["raw"], "for"))
    return T.let(label_for, lambda known: _forms_with(bare, known))


def _forms_with(bare: Column, label_for: Column) -> Column:
    def labelled(t: Column) -> Column:
        named = [_not_blank(attr(t["raw"], a)).isNotNull() for a in ("aria-label", "aria-labelledby", "title")]
        own = F.coalesce(F.array_contains(label_for, _not_blank(attr(t["raw"], "id"))), F.lit(False))
        return own | named[0] | named[1] | named[2]

    def form(f: Column) -> Column:
        inner = tags(f["body"])
        loose = tags(F.regexp_replace(f["body"], rf"(?is)<label\b{_ATTRS}>.*?</label\s*>", ""))
        email = F.exists(
            opening(inner, "input"),
            lambda t: F.coalesce(F.lower(attr(t["raw"], "type")) == "email", F.lit(False))
            | F.coalesce(F.contains(F.lower(attr(t["raw"], "name")), F.lit("mail")), F.lit(False)),
        )
        return F.struct(
            F.size(_field_tags(inner)).alias("fields"),
            email.alias("has_email"),
            F.exists(inner, lambda t: t["name"] == "textarea").alias("has_textarea"),
            F.size(F.filter(_field_tags(loose), lambda t: ~labelled(t))).alias("unlabeled"),
        )

    return F.transform(_blocks(bare, "form"), form)


def _links(bare: Column, base: Column, host: Column) -> Column:
    """array<struct<raw_href, href, text, internal, parts>> of every anchor with an address."""
    return T.let(F.struct(base.alias("base"), host.alias("host")), lambda e: _links_in(bare, e["base"], e["host"]))


def _links_in(bare: Column, base: Column, host: Column) -> Column:
    with_href = F.filter(_blocks(bare, "a"), lambda a: attr(a["head"], "href").isNotNull())

    def link(a: Column) -> Column:
        raw = T.trim_blanks(attr(a["head"], "href"))
        alt = attr(F.get(F.filter(tags(a["body"]), lambda t: (t["name"] == "img") & attr(t["raw"], "alt").isNotNull()), F.lit(0))["raw"], "alt")
        label = F.coalesce(
            _not_blank(inner_text(a["body"])), _not_blank(attr(a["head"], "aria-label")),
            _not_blank(attr(a["head"], "title")), alt, F.lit(""),
        )
        href = U.resolve(raw, base)
        return F.struct(raw.alias("raw_href"), href.alias("href"), label.alias("text"))

    def finish(x: Column) -> Column:
        parts = U.parse(F.regexp_replace(x["href"], "#.*$", ""))
        return F.struct(
            x["raw_href"].alias("raw_href"), x["href"].alias("href"), x["text"].alias("text"),
            F.coalesce(U.bare_host(parts["host"]) == host, F.lit(False)).alias("internal"),
            parts.alias("parts"),
        )

    return F.transform(F.transform(with_href, link), finish)


def page_columns(html: Column, url: Column) -> list[dict[str, Column]]:
    """Column layers to add one after the other; each layer reads the names of the layers before it."""
    c = F.col
    zero = {"_raw": without_comments(html), "_page": U.parse(url)}
    first = {"_clean": decode_references(c("_raw")), "_host": U.bare_host(c("_page")["host"])}
    half = {"_ld": json_ld(c("_raw"))}
    second = {
        "_bare": without_code(c("_clean")),
        "text": visible_text(c("_clean")),
        "schema": schema_facts(c("_ld")),
    }
    third = {"_tags": tags(c("_bare"))}
    base_href = attr(F.get(F.filter(opening(c("_tags"), "base"), lambda t: attr(t["raw"], "href").isNotNull()), F.lit(0))["raw"], "href")
    fourth = {"_base": F.coalesce(U.parse(U.resolve(base_href, c("_page"))), c("_page"))}
    base, all_tags, bare = c("_base"), c("_tags"), c("_bare")
    link_tags = opening(all_tags, "link")
    rel = lambda t: F.lower(F.coalesce(attr(t["raw"], "rel"), F.lit("")))
    icon = F.get(F.filter(link_tags, lambda t: rel(t).rlike(r"(^|\s)icon(\s|$)|^(shortcut icon|apple-touch-icon)$")), F.lit(0))
    fifth = {
        "_anchors": _links(bare, base, c("_host")),
        "scripts": _urls(all_tags, "script", base),
        "inline_scripts": F.size(F.filter(opening(all_tags, "script"), lambda t: attr(t["raw"], "src").isNull())),
        "stylesheets": F.filter(
            F.transform(
                F.filter(link_tags, lambda t: rel(t).rlike(r"(^|\s)stylesheet(\s|$)")),
                lambda t: U.resolve(attr(t["raw"], "href"), base),
            ),
            lambda u: u.isNotNull(),
        ),
        "iframes": _urls(all_tags, "iframe", base),
        "images": F.filter(
            F.transform(
                opening(all_tags, "img"),
                lambda t: F.struct(
                    U.resolve(F.coalesce(*[attr(t["raw"], a) for a in ("src", "data-src", "data-lazy-src")]), base).alias("src"),
                    attr(t["raw"], "alt").alias("alt"),
                ),
            ),
            lambda i: i["src"].isNotNull(),
        ),
        "forms": _forms(bare, all_tags),
        "hidden_emails": F.filter(
            F.transform(all_tags, lambda t: F.when(F.contains(t["raw"], F.lit("data-cfemail")), T.hidden_email(attr(t["raw"], "data-cfemail")))),
            lambda e: e.isNotNull(),
        ),
        "favicon": U.resolve(attr(icon["raw"], "href"), base),
        "title": _not_blank(inner_text(F.regexp_extract(c("_clean"), rf"(?is)<title\b{_ATTRS}>(.*?)</title\s*>", 2))),
        "meta_description": _not_blank(T.trim_blanks(_meta(all_tags, "description"))),
        "viewport": T.trim_blanks(_meta(all_tags, "viewport")),
        "generator": _not_blank(T.trim_blanks(_meta(all_tags, "generator"))),
        "robots_meta": F.lower(_meta(all_tags, "robots")),
        "lang": _not_blank(T.trim_blanks(attr(F.get(opening(all_tags, "html"), F.lit(0))["raw"], "lang"))),
        "h1": F.filter(F.transform(_blocks(bare, "h1"), lambda b: inner_text(b["body"])), lambda x: x != ""),
        "h1_count": F.size(opening(all_tags, "h1")),
        "_buttons": _blocks(bare, "button"),
        "deprecated_tags": T.let(
            F.transform(opening(all_tags, *P.DEPRECATED_TAGS), lambda t: t["name"]),
            lambda used: F.filter(
                literal_array(P.DEPRECATED_TAGS), lambda name: F.array_contains(used, name)
            ),
        ),
        "uses_flash": F.exists(
            opening(all_tags, "embed", "object"),
            lambda t: F.coalesce(attr(t["raw"], "type") == "application/x-shockwave-flash", F.lit(False))
            | F.coalesce(F.when(t["name"] == "embed", attr(t["raw"], "src")).otherwise(attr(t["raw"], "data")).endswith(".swf"), F.lit(False)),
        ),
        "_tables": F.size(opening(all_tags, "table")),
        "_layout_tables": _nested_tables(all_tags),
        "_divs": F.size(opening(all_tags, "div")),
        "_children": _body_children(all_tags),
        "noscript_js": F.exists(_blocks(c("_clean"), "noscript"), lambda b: b["body"].rlike("(?i)javascript")),
        "has_nav": F.exists(
            all_tags,
            lambda t: ~t["closing"] & ((t["name"] == "nav") | F.coalesce(attr(t["raw"], "role") == "navigation", F.lit(False))),
        ) | F.exists(_blocks(bare, "header"), lambda b: b["body"].rlike(r"(?is)<ul\b.*<li\b.*<a\b")),
    }
    anchors = c("_anchors")
    links = F.filter(anchors, lambda a: a["parts"].isNotNull() & ~a["raw_href"].rlike("(?i)^(tel|mailto):"))
    plus_kept = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    tel = F.transform(
        F.filter(anchors, lambda a: a["raw_href"].rlike("(?i)^tel:")), lambda a: plus_kept(F.substring(a["raw_href"], 5, WHOLE))
    )
    mailto = F.flatten(F.transform(
        F.filter(anchors, lambda a: a["raw_href"].rlike("(?i)^mailto:")),
        lambda a: F.transform(
            F.split(plus_kept(F.split_part(F.substring(a["raw_href"], 8, WHOLE), F.lit("?"), F.lit(1))), ","),
            lambda m: T.trim_blanks(m),
        ),
    ))
    submit = F.transform(
        F.filter(opening(all_tags, "input"), lambda t: F.coalesce(F.lower(attr(t["raw"], "type")) == "submit", F.lit(False))),
        lambda t: T.squeeze(F.coalesce(attr(t["raw"], "value"), F.lit(""))),
    )
    has_role = bare.rlike("(?i)role")  # without the word no element can have the attribute
    role_buttons = F.when(has_role, F.flatten(F.array(*[
        F.transform(
            F.filter(_blocks(bare, n), lambda b: F.coalesce(attr(b["head"], "role") == "button", F.lit(False))),
            lambda b: inner_text(b["body"]),
        )
        for n in ("a", "div", "span")
    ]))).otherwise(F.array().cast("array<string>"))
    sixth = {
        "links": links,
        "tel_links": F.filter(tel, lambda x: x.isNotNull()),
        "mailto_links": F.filter(mailto, lambda x: F.coalesce(x != "", F.lit(False))),
        "word_count": T.words(c("text")),
        "links_without_text": F.size(F.filter(anchors, lambda a: a["text"] == "")),
        "buttons_without_name": F.size(F.filter(
            c("_buttons"),
            lambda b: (inner_text(b["body"]) == "") & _not_blank(attr(b["head"], "aria-label")).isNull()
            & _not_blank(attr(b["head"], "title")).isNull(),
        )),
        "_button_texts": F.filter(
            F.concat(F.transform(c("_buttons"), lambda b: inner_text(b["body"])), submit, role_buttons), lambda x: x != ""
        ),
        "images_without_alt": F.size(F.filter("images", lambda i: i["alt"].isNull())),
        "inputs_without_label": F.aggregate("forms", F.lit(0), lambda a, f: a + f["unlabeled"]),
        "table_layout": (c("_layout_tables") >= 2) & (c("_tables") >= 2) & (c("_divs") < c("_tables") * 3),
        "fixed_viewport": T.has(c("viewport"), P.FIXED_VIEWPORT),
        "app_shell": F.exists(all_tags, lambda t: t["name"] == "script") & (bare.rlike(SHELL_ROOTS) | (c("_children") <= 1)),
        "mixed_content": F.when(
            url.startswith("https:"),
            F.filter(
                F.concat("scripts", "stylesheets", F.transform("images", lambda i: i["src"]), "iframes"),
                lambda u: u.startswith("http:"),
            ),
        ).otherwise(F.array().cast("array<string>")),
    }
    booking_host = lambda u: F.get(
        F.filter(literal_array(BOOKING_HOSTS), lambda h: F.contains(F.lower(u), h)), F.lit(0))
    signal = lambda u, lab: F.struct(u.cast("string").alias("url"), lab.cast("string").alias("label"))

    def link_signals(x: Column) -> Column:
        found = F.struct(booking_host(x["href"]).alias("h"), U.platform(x["parts"]["host"], x["parts"]["path"]).alias("p"))
        return T.let(found, lambda f: signals(x, f["h"], f["p"]))

    def signals(x: Column, host_hit: Column, platform: Column) -> Column:
        own = (
            F.when(host_hit.isNotNull(), F.coalesce(_not_blank(x["text"]), host_hit))
            .when(x["text"].rlike(java(P.BOOKING_TEXT)) & ~x["text"].rlike(java(P.RIGHTS_RESERVED)), x["text"])
            .when(x["internal"] & x["parts"]["path"].rlike(java(P.BOOKING_PATH)), F.coalesce(_not_blank(x["text"]), F.lit("Página de cita/reserva")))
        )
        by_kind = F.when(platform["kind"].isin("BOOKING_PLATFORM", "DELIVERY"), platform["label"])
        return F.filter(F.array(signal(x["href"], own), signal(x["href"], by_kind)), lambda s: s["label"].isNotNull())

    widgets = F.filter(
        F.transform(
            F.concat("iframes", "scripts"),
            lambda u: signal(u, F.concat(F.lit("Widget/integración de reservas ("), booking_host(u), F.lit(")"))),
        ),
        lambda s: s["label"].isNotNull(),
    )
    from_buttons = F.transform(F.filter("_button_texts", lambda x: x.rlike(java(P.BOOKING_TEXT))), lambda x: signal(url, x))
    short_cta = lambda x: (x != "") & (F.length(x) <= 40) & x.rlike(java(P.CTA))
    seventh = {
        "booking_signals": _first_by(F.concat(widgets, F.flatten(F.transform("links", link_signals)), from_buttons), "url"),
        "menu_links": F.transform(
            F.filter("links", lambda x: x["text"].rlike(java(P.MENU_TEXT)) | x["parts"]["path"].rlike(java(P.MENU_PATH))),
            lambda x: F.struct(x["href"].alias("url"), x["href"].rlike(java(P.PDF_LINK)).alias("is_pdf")),
        ),
        "contact_pages": F.array_distinct(F.transform(
            F.filter("links", lambda x: x["internal"] & (x["parts"]["path"].rlike(java(P.CONTACT_LINK)) | x["text"].rlike(java(P.CONTACT_LINK)))),
            lambda x: x["href"],
        )),
        "cta_texts": F.array_distinct(F.concat(
            F.transform(F.filter("links", lambda x: short_cta(x["text"])), lambda x: x["text"]),
            F.filter("_button_texts", short_cta),
            F.when(F.size("tel_links") > 0, F.array(F.lit("tel:"))).otherwise(F.array().cast("array<string>")),
        )),
        "has_map": F.exists("iframes", lambda u: u.rlike(java(P.MAP_FRAME))) | F.exists("links", lambda x: x["href"].rlike(java(P.MAP_LINK))),
    }
    return [zero, first, half, second, third, fourth, fifth, sixth, seventh]
