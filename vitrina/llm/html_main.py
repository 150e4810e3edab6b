"""Main text of a web page by a maximum-scoring run of words and tags.

A page becomes one sequence of tokens. Words carry the weight of their place (nearest block element, inside a link or
not), tags the weight of their name; both are log odds from labelled pages: pages with exactly one <article> label their
own words, inside or outside. Words are worth something, tags cost something, and one linear scan finds the contiguous
run with the highest sum. Elements that are never article text (scripts, styles, menus, forms, page headers, footers,
sidebars, notices, adverts, reader comments; told by element, role or class name) score nothing and are left out of the
text, so they neither attract nor break the run. Class names do not leave out an element that holds most unlinked words of
the page's articles (of its <main> if no article has any, else of the page): that is a wrapper. Reader comments, role and
hiding are left out at any size.

Text: character references decoded, white space inside a block one space, blocks joined by one space in page order.
Null, empty and tag-only pages give an empty text. Rows are independent; repeated rows give repeated results; other
columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import prepare

# Element names of the HTML standard by role, and common class words of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead title tr ul".split())
STRUCTURE = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre hr figure figcaption".split()) | {"html", "a", "img"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside form iframe object svg canvas math button select textarea"
    " dialog menu search audio video map title input datalist".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = frozenset("option optgroup tbody thead tfoot tr td th caption html body head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:s|ed)?|promos?|promotions?|banners?|cookies?|consent"
    r"|gdpr|notices?|notifications?|alerts?|popups?|popover|modals?|overlays?|newsletters?|subscri(?:be|ption)s?|signup|signin|login"
    r"|sidebars?|sidenav|menus?|nav|navs|navbar|navigation|breadcrumbs?|footers?|footnav|masthead|topbar|toolbars?|share|sharing"
    r"|social|related|recommend(?:ed|ations?)|comments?|commentlist|commentform|disqus|respond|replies|reply|widgets?|pagination|pager"
    r"|skip|skiplink|searchbox|searchform|disclaimer|teasers?|outbrain|taboola)")
COMMENTS = frozenset("comment comments commentlist commentform disqus respond reply replies".split())
CONTENT = frozenset("content article post entry main story".split())
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|(?P<text>[^<]++|<)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _furniture(attrs: str) -> str:
    """Why an element with these attributes is page furniture: "sure" (role, hiding, comments), "class" words, or ""."""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if found.get("role", "").strip().lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "sure"
    if _HIDDEN.search(found.get("style", "")):
        return "sure"
    names = [n for key in ("class", "id") for n in found.get(key, "").split()]
    if any(n.lower() in CONTENT for n in names):
        return ""
    why = ""
    for name in names:
        words = [w.lower() for w in _CLASS_WORD.findall(name)]
        if words and words[0] not in ("has", "with", "no", "without") and any(FURNITURE.fullmatch(w) for w in words):
            if not COMMENTS.isdisjoint(words):
                return "sure"
            why = "class"
    return why


class Token:
    """A word piece or a tag of the page."""

    __slots__ = ("key", "text", "block", "left_out", "labelled")

    def __init__(self, key, text, block, left_out, labelled):
        self.key, self.text, self.block, self.left_out, self.labelled = key, text, block, left_out, labelled


def tokens(page: str, by_class: bool = True) -> list[Token]:
    """Tags have text None. ``block`` grows at every block edge; ``labelled`` tells whether an <article> is open."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, article
    within: list[tuple[int, ...]] = []  # for each open element, the elements with furniture's class words around it
    marked: list[tuple[int, ...]] = []  # the same for each token
    mains: list[bool] = []  # for each token, is a <main> open?
    n_marked = 0
    open_names: Counter = Counter()
    block, raw = 0, ""

    def pop() -> None:
        open_names[stack.pop()[0]] -= 1
        within.pop()

    def put(token: Token, around: tuple[int, ...]) -> None:
        out.append(token)
        marked.append(around)
        mains.append(bool(open_names["main"]))

    def close_to(name: str) -> None:
        while stack and stack[-1][0] != name:
            pop()
        if stack:
            pop()

    pos = 0
    while pos < len(page):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, pos)
            pos, raw = (end.start() if end else len(page)), ""
            continue
        m = _TOKEN.match(page, pos)
        pos = m.end()
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if m["text"] == "<" and page[pos:pos + 1].isascii() and re.match("[A-Za-z/]", page[pos:pos + 1]):  # a tag that never ends
            break
        if m["text"] is not None:
            where = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "body") if not dropped else ""
            key = ("w", where, bool(open_names["a"]))
            put(Token(key, html.unescape(m["text"]), block, dropped, article), within[-1] if within else ())
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name == "br":
            block += 1
        if m["close"]:
            put(Token(("t", name), None, block, dropped, article), within[-1] if within else ())
            if open_names[name]:
                close_to(name)
            continue
        if name in BLOCKS and name not in KEEPS_P and open_names["p"]:
            close_to("p")
        for ended in CLOSED_BY.get(name, ()):
            if open_names[ended] and stack and (stack[-1][0] == ended or stack[-1][0] not in ("ul", "ol", "dl", "table")):
                inner = next(n for n, _, _ in reversed(stack) if n in ("ul", "ol", "dl", "table", "select", ended)
                             ) if any(n in ("ul", "ol", "dl", "table", "select", ended) for n, _, _ in stack) else ""
                if inner == ended:
                    close_to(ended)
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        around = within[-1] if within else ()
        gone = dropped or name in DROPPED or (name == "header" and not article and not open_names["main"])
        if not gone and by_class and name not in ("html", "body", "main", "article"):
            why = _furniture(m["attrs"]) if m["attrs"] else ""
            gone = why == "sure"
            if why == "class":
                n_marked += 1
                around = (*around, n_marked)
        article = article or name == "article"
        put(Token(("t", name), None, block, gone, article and name != "article"), around)
        if name in RAW:
            raw = name
            stack.append((name, gone, article))
            within.append(around)
            open_names[name] += 1
        elif name not in VOID:
            stack.append((name, gone, article))
            within.append(around)
            open_names[name] += 1
    if n_marked:
        words = [0 if t.text is None or t.left_out or t.key[2] else len(t.text.split()) for t in out]
        counted = [n if t.labelled else 0 for t, n in zip(out, words)]
        if not any(counted):
            counted = [n if m else 0 for n, m in zip(words, mains)]
        if not any(counted):
            counted = words
        held: Counter = Counter()
        for own, n in zip(marked, counted):
            for k in own:
                held[k] += n
        total = sum(counted)
        for t, own in zip(out, marked):
            t.left_out = t.left_out or any(2 * held[k] <= total for k in own)
    return out


def learn(pages: list[str], prior: float = 10.0) -> dict:
    """Log odds of each kind of word and tag: inside against outside the only <article> of a labelled page.

    ``prior`` pseudo-counts stand for what is known without pages: words are text, linked words and tags are not.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        if len(re.findall(r"<article\b", page, re.I)) != 1:
            continue
        for t in tokens(page):
            if not t.left_out and t.key != ("t", "article"):
                (inside if t.labelled else outside)[t.key] += 1 if t.text is None else len(t.text.split())
    weights = {}
    for key in set(inside) | set(outside):
        odds = math.log((inside[key] + prior) / (outside[key] + prior))
        if key[0] == "w":
            base = -1.0 if key[2] else 1.0
            weights[key] = max(-3.0, min(3.0, base + 0.5 * odds)) if key[2] else max(0.2, min(3.0, base + 0.5 * odds))
        else:
            weights[key] = max(-3.0 if key[1] in STRUCTURE else -0.05, min(-0.01, odds - 0.01))
    return weights


def _weight(key: tuple, weights: dict) -> float:
    if key in weights:
        return weights[key]
    if key[0] == "w":
        return -1.0 if key[2] else 1.0
    return -0.5 if key[1] in STRUCTURE else -0.01


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one-past-last index of the contiguous run with the largest positive sum; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: dict) -> str:
    """The main text of one page."""
    if not page:
        return ""
    for by_class in (True, False):
        seq = tokens(page, by_class)
        if any(t.text and not t.left_out and not t.text.isspace() for t in seq):
            break
    scores = []
    for t in seq:
        if t.left_out:
            scores.append(0.0)
            continue
        w = _weight(t.key, weights)
        if t.text is None:
            scores.append(-3.0 if t.key[1] == "article" else w)
        else:
            scores.append(w * len(t.text.split()))
    first, last = best_run(scores)
    parts, block = [], None
    for t in seq[first:last]:
        if t.text is not None and not t.left_out:
            if block is not None and t.block != block:
                parts.append(" ")
            parts.append(t.text)
            block = t.block
    return " ".join("".join(parts).split())


def labelled_weights(pages: DataFrame, sample: int = 600) -> dict:
    """Weights from about ``sample`` pages (a documented bound), drawn by a hash over all pages that have an <article>."""
    rows = pages.select("page_id", "html").where(F.col("html").rlike(r"(?i)<article\b"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("pages"), "page_id"), F.lit(1 << 30)) / float(1 << 30)
    return learn(sorted(r["html"] for r in rows.where(draw < sample / max(n, 1)).select("html").collect()))


def main_text(pages: DataFrame, sample: int = 600) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    prepare(spark)
    weights = spark.sparkContext.broadcast(labelled_weights(pages, sample))

    def run(batches):
        for batch in batches:
            text = [extract(h, weights.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
