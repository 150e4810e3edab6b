"""Opening-hours column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = "array<struct<day:int,open:string,close:string>>"
# --- fixed values: day abbreviations of the map-data hours syntax, Sunday first ----------------
DAY_ABBREVIATIONS = ["su", "mo", "tu", "we", "th", "fr", "sa"]
# --- end of fixed values ---------------------------------------------------------------------
_RANGE = r"\d{2}:\d{2}-\d{2}:\d{2}(?:\s*,\s*\d{2}:\d{2}-\d{2}:\d{2})*"
_RULE = rf"(?i)^([A-Za-z,\- ]+?)\s+(off|closed|{_RANGE})$"


def clock(t: Column, is_close: bool = False) -> Column:
    """``9:00`` -> ``09:00``; a closing time at midnight reads ``24:00``."""
    s = F.trim(t)
    hhmm = F.concat(
        F.lpad(F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 1), 2, "0"),
        F.lit(":"),
        F.regexp_extract(s, r"^(\d{1,2}):(\d{2})", 2),
    )
    out = F.when(s.rlike(r"^\d{1,2}:\d{2}"), hhmm).otherwise(s)
    return F.when(out.isin("00:00", "23:59"), "24:00").otherwise(out) if is_close else out


def minute_of_day(t: Column) -> Column:
    return F.split_part(t, F.lit(":"), F.lit(1)).cast("int") * 60 + F.coalesce(
        F.split_part(t, F.lit(":"), F.lit(2)).try_cast("int"), F.lit(0)
    )


def structured_periods(periods: Column) -> Column:
    """Provider periods (open/close structs) -> day/open/close; the open-ended Sunday marker is left out."""
    def pad(part: Column) -> Column:
        return F.lpad(F.coalesce(part, F.lit(0)).cast("string"), 2, "0")

    kept = F.filter(periods, lambda p: p["open"].isNotNull() & ~_always(p))
    return F.transform(
        kept,
        lambda p: F.struct(
            F.coalesce(p["open"]["day"], F.lit(0)).alias("day"),
            F.concat(pad(p["open"]["hour"]), F.lit(":"), pad(p["open"]["minute"])).alias("open"),
            F.when(
                p["close"].isNotNull(), F.concat(pad(p["close"]["hour"]), F.lit(":"), pad(p["close"]["minute"]))
            ).otherwise("24:00").alias("close"),
        ),
    )


def _always(p: Column) -> Column:
    return (
        p["close"].isNull()
        & F.coalesce(p["open"]["day"] == 0, F.lit(False))
        & (F.coalesce(p["open"]["hour"], F.lit(0)) == 0)
        & (F.coalesce(p["open"]["minute"], F.lit(0)) == 0)
    )


def structured_always_open(periods: Column) -> Column:
    return F.coalesce(F.exists(periods, lambda p: p["open"].isNotNull() & _always(p)), F.lit(False))


def _day_number(abbr: Column) -> Column:
    """0 = Sunday, NULL for an unknown abbreviation."""
    at = F.array_position(F.array(*[F.lit(d) for d in DAY_ABBREVIATIONS]), F.lower(abbr))
    return F.when(at > 0, (at - 1).cast("int"))


def _days(spec: Column) -> Column:
    """Day numbers of ``Mo-Fr,Su``; ranges may wrap the week; NULL inside when any part is unknown."""
    def one(part: Column) -> Column:
        lo = _day_number(F.regexp_extract(part, "^([A-Za-z]{2})", 1))
        hi = _day_number(F.regexp_extract(part, "([A-Za-z]{2})$", 1))
        # the week runs Monday to Sunday here, so that Sa-Su and Su-Mo both walk forward
        start, stop = (lo + 6) % 7, (hi + 6) % 7
        span = F.transform(
            F.sequence(F.lit(0), (stop - start + 7) % 7), lambda k: ((start + k + 1) % 7).cast("int")
        )
        single = F.array(_day_number(part))
        return F.when(
            part.rlike("^[A-Za-z]{2}-[A-Za-z]{2}$"),
            F.coalesce(span, F.array(F.lit(None).cast("int"))),
        ).otherwise(single)

    return F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(spec, r"\s+", ""), ","), one)))


def text_periods(raw: Column) -> Column:
    """struct<periods, always_open>: one unreadable rule empties the whole result."""
    text = F.trim(raw)
    rules = F.filter(
        F.transform(F.split(text, ";"), lambda r: F.trim(r)), lambda r: (r != "") & ~r.rlike(r"(?i)^PH(?![A-Za-z0-9_])")
    )
    timed = rf"^{_RANGE}$"
    parsed = F.transform(
        rules,
        lambda r: F.struct(
            F.when(r.rlike(_RULE), _days(F.regexp_extract(r, _RULE, 1)))
            .when(r.rlike(timed), F.sequence(F.lit(0), F.lit(6)))
            .alias("days"),
            F.when(r.rlike(_RULE), F.regexp_extract(r, _RULE, 2)).otherwise(r).alias("times"),
        ),
    )
    bad = F.exists(parsed, lambda p: p["days"].isNull() | F.exists(p["days"], lambda d: d.isNull()))
    open_rules = F.filter(parsed, lambda p: ~F.lower(p["times"]).isin("off", "closed"))
    periods = F.flatten(
        F.transform(
            open_rules,
            lambda p: F.flatten(
                F.transform(
                    F.split(p["times"], ","),
                    lambda span: F.transform(
                        p["days"],
                        lambda d: F.struct(
                            d.alias("day"),
                            F.split_part(F.trim(span), F.lit("-"), F.lit(1)).alias("open"),
                            F.split_part(F.trim(span), F.lit("-"), F.lit(2)).alias("close"),
                        ),
                    ),
                )
            ),
        )
    )
    always = text == "24/7"
    return F.when(
        text != "",
        F.struct(
            F.when(always | bad, F.array().cast(_DAYS)).otherwise(periods.cast(_DAYS)).alias("periods"),
            always.alias("always_open"),
        ),
    )
