"""Phone column builders over a small numbering-plan table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import literal_array
from .text import first_few, let
from ..rules.phones import PHONE_PLANS

# a number never begins at a letter, nor goes on with anything but these signs: most places are left after one look
_CANDIDATE = r"(?![A-Za-z])(?:^|[^0-9+A-Za-z])(?=[+(0-9])((?:\+|00)?[(]?[0-9](?:[ ().-]?[0-9]){7,14})(?![0-9])"


def _plans() -> Column:
    return literal_array(
        {"country": p.country, "code": p.calling_code, "lo": p.min_len, "hi": p.max_len, "trunk": p.trunk, "valid": p.valid}
        for p in PHONE_PLANS
    )


def _parsed(raw: Column, country: Column) -> Column:
    """struct<plan, nsn>: numbering plan and national number, NULL when no plan applies."""
    def facts(c: Column) -> Column:
        digits = F.regexp_replace(c, "[^0-9]", "")
        rest = F.when(c.startswith("+"), digits).otherwise(F.regexp_replace(digits, "^00", ""))
        return F.struct(
            c.rlike(r"^[+0-9(][0-9 ().\-/]*$").alias("shaped"), c.rlike(r"^\(?(\+|00)").alias("abroad"),
            digits.alias("digits"), rest.alias("rest"),
        )

    def plan_of(f: Column) -> Column:
        by_code = F.array_max(F.transform(
            F.filter(_plans(), lambda p: f["rest"].startswith(p["code"])),
            lambda p: F.struct(F.length(p["code"]).alias("n"), p.alias("plan")),
        ))["plan"]
        by_country = F.get(F.filter(_plans(), lambda p: p["country"] == F.upper(country)), F.lit(0))
        return F.when(f["abroad"], by_code).otherwise(by_country)

    def strip_trunk(plan: Column, local: Column) -> Column:
        return F.when(
            (plan["trunk"] != "") & local.startswith(plan["trunk"]),
            F.substring(local, F.length(plan["trunk"]) + 1, F.lit(32)),
        ).otherwise(local)

    def number(f: Column, plan: Column) -> Column:
        local = F.when(f["abroad"], F.substring(f["rest"], F.length(plan["code"]) + 1, F.lit(32))).otherwise(f["digits"])
        return let(
            let(local, lambda x: strip_trunk(plan, x)),
            lambda nsn: F.when(
                f["shaped"] & plan.isNotNull() & F.length(nsn).between(plan["lo"], plan["hi"]),
                F.struct(plan.alias("plan"), nsn.alias("nsn")),
            ),
        )

    cleaned = F.trim(F.regexp_replace(raw, "(?i)^tel:", ""))
    return let(let(cleaned, facts), lambda f: let(plan_of(f), lambda plan: number(f, plan)))


def e164(raw: Column, country: Column) -> Column:
    return let(_parsed(raw, country), lambda p: F.concat(F.lit("+"), p["plan"]["code"], p["nsn"]))


def national(raw: Column, country: Column) -> Column:
    """Number as dialled at home, grouped the way the plan prints it."""
    return let(_parsed(raw, country), _grouped)


def _grouped(p: Column) -> Column:
    text = F.concat(p["plan"]["trunk"], p["nsn"])
    for plan in PHONE_PLANS:
        sizes = [int(g) for g in plan.groups.split("-")]
        cuts, at = [], 1
        for i, size in enumerate(sizes):
            width = size if i < len(sizes) - 1 else 32
            cuts.append(F.nullif(F.substring(p["nsn"], at, width), F.lit("")))
            at += size
        # North American numbers are printed without the long-distance 1
        grouped = F.concat(F.lit("" if plan.country == "US" else plan.trunk), F.concat_ws(" ", *cuts))
        text = F.when(p["plan"]["country"] == plan.country, grouped).otherwise(text)
    return text


def same_phone(a: Column, b: Column, country: Column) -> Column:
    return F.coalesce(e164(a, country) == e164(b, country), F.lit(False))


def phones_in_text(text: Column, country: Column, limit: int | None = None) -> Column:
    """Distinct valid numbers of a text in E.164 form, in order of appearance."""
    raw = F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(1))
    parsed = F.transform(raw, lambda r: _parsed(r, country))
    valid = F.filter(parsed, lambda p: p.isNotNull() & F.coalesce(F.regexp_like(p["nsn"], p["plan"]["valid"]), F.lit(False)))
    numbers = F.transform(valid, lambda p: F.concat(F.lit("+"), p["plan"]["code"], p["nsn"]))
    return first_few(F.array_distinct(numbers), limit)
