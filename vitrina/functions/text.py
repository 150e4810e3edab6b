"""Text column builders: normalising, snippets, tokens, mentions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import patterns as P
from ..rules.regex import BLANKS, java, starting


def _accent_pairs() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus combining marks."""
    src, dst = [], []
    for lo, hi in [(0x00C0, 0x0250), (0x0370, 0x0500), (0x1E00, 0x2000)]:
        for cp in range(lo, hi):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not 0x300 <= ord(c) <= 0x36F)
            if base != chr(cp) and len(base) == 1:
                src.append(chr(cp))
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_pairs()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip_accents(c: Column) -> Column:
    plain = F.translate(c, ACCENTED, PLAIN)
    return F.regexp_replace(plain, r"[\x{0300}-\x{036f}]", "")


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, starting("\t\n\x0b\f\r ") + f"[{BLANKS}]+", " "))  # only plain spaces are left to trim


def normalize_text(c: Column) -> Column:
    return squeeze(F.lower(strip_accents(c)))


def truncate(c: Column, limit: int) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, max(0, limit - 1)), f"[{BLANKS}]+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def has(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(java(pattern, ignore_case)), F.lit(False))


def first_match(c: Column, pattern: str) -> tuple[Column, Column]:
    """(zero-based start or -1, matched length)."""
    p = F.lit(java(pattern))
    return F.regexp_instr(c, p) - 1, F.length(F.regexp_substr(c, p))


def snippet(c: Column, index: Column, match_length: Column, radius: int = 70) -> Column:
    start = F.greatest(F.lit(0), index - radius)
    end = F.least(F.length(c), index + match_length + radius)
    core = squeeze(F.substring(c, start + 1, end - start))
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        core,
        F.when(end < F.length(c), F.lit("…")).otherwise(F.lit("")),
    )


def match_snippet(c: Column, pattern: str, radius: int = 70) -> Column:
    """Snippet round the first match, NULL without one."""
    index, length = first_match(c, pattern)
    at = F.struct(index.alias("i"), length.alias("n"))
    return let(at, lambda m: F.when(m["i"] >= 0, snippet(c, m["i"], m["n"], radius)))


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("bigint")


def name_tokens(c: Column) -> Column:
    spaced = F.regexp_replace(normalize_text(c), "[^a-z0-9ñ ]", " ")
    return F.filter(F.split(spaced, " "), lambda t: (F.length(t) >= 3) & ~t.isin(P.NAME_STOPWORDS))


def covered(tokens: Column, hay: Column) -> Column:
    """Share of tokens found in normalised text; 0 without tokens."""
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.size(F.filter(tokens, lambda t: F.contains(hay, t))) / F.size(tokens))


def name_coverage(name: Column, haystack: Column) -> Column:
    both = F.struct(name_tokens(name).alias("tokens"), normalize_text(haystack).alias("hay"))
    return let(both, lambda b: covered(b["tokens"], b["hay"]))


def first_few(items: Column, limit: int | None) -> Column:
    """The first ``limit`` items; all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def emails(text: Column, extra: Column | None = None, limit: int | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(java(P.EMAIL)), F.lit(1))
    if extra is not None:
        found = F.concat(extra, found)
    clean = F.transform(found, lambda e: F.lower(F.regexp_replace(trim_blanks(e), r"^[.]+|[.]+$", "")))
    keep = F.filter(
        clean,
        lambda e: e.rlike(java(P.EMAIL_SHAPE)) & ~e.rlike("|".join(f"(?:{java(b)})" for b in P.EMAIL_BLOCKED)),
    )
    return first_few(F.array_distinct(keep), limit)


def hidden_email(hex_text: Column) -> Column:
    """Address hidden as hex bytes, each XORed with the first one."""
    def byte(text: Column, at: Column) -> Column:
        return F.conv(F.substring(text, at, F.lit(2)), 16, 10).cast("int")

    def plain(text: Column) -> Column:
        steps = F.sequence(F.lit(3), F.greatest(F.length(text), F.lit(3)), F.lit(2))
        return let(byte(text, F.lit(1)), lambda key: F.array_join(
            F.transform(steps, lambda at: F.char(byte(text, at).bitwiseXOR(key))), ""))

    def address(text: Column) -> Column:
        ok = text.rlike("^(?i)[0-9a-f]{4,}$")
        return F.when(ok, let(plain(text), lambda found: F.when(F.contains(found, F.lit("@")), found)))

    # the text may be an expression of its own; written into the steps it would be computed again for every byte
    return let(hex_text, address)


def copyright_years(text: Column) -> Column:
    p = java(P.COPYRIGHT)
    first = F.regexp_extract_all(text, F.lit(p), F.lit(1))
    last = F.regexp_extract_all(text, F.lit(p), F.lit(2))
    years = F.zip_with(
        first, last, lambda a, b: F.greatest(a.cast("int"), F.when(b != "", b.cast("int")).otherwise(F.lit(0)))
    )
    return F.array_distinct(F.filter(years, lambda y: (y >= 1995) & (y <= 2100)))


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<at, hit>>: zero-based start and text of every match, left to right.

    The pieces between matches come from ``split``; each start is the length of all earlier pieces and hits. Starts are
    summed within runs of ``_RUN`` matches and then over the runs, as an array that grows step by step is copied each time.
    """
    p = java(pattern)

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, p), lambda g: F.length(g))
        pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) == 0, F.array().cast("array<struct<at:int,hit:string>>")).otherwise(let(let(pairs, by_runs), joined))

    def by_runs(all_pairs: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_pairs) - 1) / _RUN), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: _walk(F.slice(all_pairs, b * _RUN + 1, _RUN)))

    def joined(runs: Column) -> Column:
        begins = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
            lambda acc, r: F.struct((acc["pos"] + r["pos"]).cast("int").alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
        )["out"]
        return F.flatten(F.zip_with(runs, begins, lambda r, begin: F.transform(
            r["out"], lambda m: F.struct((m["at"] + begin).cast("int").alias("at"), m["hit"].alias("hit")))))

    # a text without a match is not cut a second time
    return let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), placed)


_RUN = 128


def _walk(pairs: Column) -> Column:
    """struct<pos, out>: length of a short run of (gap, hit) pairs and the start of each hit within it."""
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))
    return F.aggregate(
        pairs,
        state,
        lambda acc, m: F.struct(
            (acc["pos"] + m["gap"] + F.length(m["hit"])).cast("int").alias("pos"),
            F.concat(
                acc["out"],
                F.array(F.struct((acc["pos"] + m["gap"]).cast("int").alias("at"), m["hit"].alias("hit"))),
            ).alias("out"),
        ),
    )


def _around(text: Column, at: Column, back: int, ahead: int) -> Column:
    start = F.greatest(F.lit(0), at - back)
    return F.substring(text, start + 1, at + ahead - start)


def dated_mentions(text: Column, current_year: int, limit: int | None = None) -> Column:
    """array<struct<year, text>> of event words next to a past year."""
    years = F.filter(
        match_offsets(text, r"(?:19|20)\d{2}"),
        lambda m: (m["hit"].cast("int") >= 2000)
        & (m["hit"].cast("int") <= current_year - 2)
        & _around(text, m["at"], 45, 10).rlike(java(P.EVENT_WORDS))
        & ~_around(text, m["at"], 30, 0).rlike(java(P.SINCE_WORDS)),
    )
    return F.transform(
        first_few(years, limit),
        lambda m: F.struct(
            m["hit"].cast("int").alias("year"), snippet(text, m["at"], F.lit(4), 60).alias("text")
        ),
    )


def stale_notices(text: Column) -> Column:
    """array<struct<kind, text>>, at most one notice of each kind."""
    kinds = [("covid", P.STALE_COVID), ("temporarily_closed", P.TEMPORARILY_CLOSED)]
    return F.array_compact(
        F.array(*[
            F.when(
                has(text, p),
                F.struct(F.lit(k).alias("kind"), match_snippet(text, p).alias("text")),
            )
            for k, p in kinds
        ])
    )


def hours_texts(text: Column, limit: int | None = None) -> Column:
    hits = first_few(match_offsets(text, P.HOURS_TEXT), limit)
    return F.transform(hits, lambda m: snippet(text, m["at"], F.length(m["hit"]), 25))


def address_texts(text: Column, limit: int | None = None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(java(P.ADDRESS_TEXT)), F.lit(0))
    return F.array_distinct(F.transform(first_few(hits, limit), trim_blanks))


def postal_codes(text: Column, limit: int | None = None) -> Column:
    """Five-digit codes with an address word near by."""
    hits = F.filter(
        match_offsets(text, P.POSTAL_CODE),
        lambda m: _around(text, m["at"], 80, 40).rlike(java(P.POSTAL_CONTEXT)),
    )
    return first_few(F.array_distinct(F.transform(hits, lambda m: m["hit"])), limit)


def placeholder_kind(text: Column) -> Column:
    n = words(text)
    return (
        F.when(has(text, P.PARKED) & (n < P.PARKED_MAX_WORDS), "PARKED")
        .when(has(text, P.UNDER_CONSTRUCTION) & (n < P.UNDER_CONSTRUCTION_MAX_WORDS), "UNDER_CONSTRUCTION")
        .when(has(text, P.PLACEHOLDER), "PLACEHOLDER")
    )


def placeholder_snippet(text: Column) -> Column:
    kind = placeholder_kind(text)
    return (
        F.when(kind == "PARKED", match_snippet(text, P.PARKED, 60))
        .when(kind == "UNDER_CONSTRUCTION", match_snippet(text, P.UNDER_CONSTRUCTION, 60))
        .when(kind == "PLACEHOLDER", match_snippet(text, P.PLACEHOLDER, 60))
    )


def redact(text: Column) -> Column:
    """Secrets in running text replaced, the part before (and after) them kept."""
    for pattern, ignore_case in P.SECRETS_IN_TEXT:
        tail = "$2" if pattern.count("(@)") else ""
        text = F.regexp_replace(text, java(pattern, ignore_case), "$1[REDACTED]" + tail)
    return text


def redact_map(fields: Column) -> Column:
    """Map values hidden when the key names a secret, otherwise redacted as text."""
    return F.transform_values(
        fields, lambda k, v: F.when(k.rlike(java(P.SECRET_KEY_NAME)), F.lit("[REDACTED]")).otherwise(redact(v))
    )


def public_entity(name: Column) -> Column:
    return has(trim_blanks(name), P.PUBLIC_ENTITY)
