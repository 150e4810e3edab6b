"""Column builders for display text: labels, relative time, money, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import scoring as S
from ..rules.categories import CATEGORIES, NO_CATEGORY_LABEL
from .literals import lookup


def label(pairs: dict[str, str], key: Column) -> Column:
    return lookup(pairs, key)


def category_label(key: Column, lang: str = "es") -> Column:
    names = {c.key: (c.label_es if lang == "es" else c.label_en) for c in CATEGORIES}
    return F.when(key.isNull() | (key == ""), NO_CATEGORY_LABEL).otherwise(F.coalesce(label(names, key), key))


def relative_time(at: Column, as_of: Column) -> Column:
    """``hace 3 días`` / ``en 1 hora`` / ``ahora``; a dash for no date."""
    ms = F.unix_millis(as_of) - F.unix_millis(at)
    gap = F.abs(ms)

    def say(unit_ms: int, name: str) -> Column:
        n = F.floor(gap / unit_ms).cast("bigint")
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))
        return F.when(ms < 0, F.concat(F.lit("en "), text)).otherwise(F.concat(F.lit("hace "), text))

    return (
        F.when(at.isNull(), "—")
        .when(gap >= 86_400_000, say(86_400_000, "día"))
        .when(gap >= 3_600_000, say(3_600_000, "hora"))
        .when(gap >= 60_000, say(60_000, "minuto"))
        .otherwise("ahora")
    )


def money(amount: Column) -> Column:
    # exact ties are eighths and round up; everything else follows the stored binary value
    tie = amount * 8 == F.floor(amount * 8)
    shown = F.replace(F.format_number(F.when(tie, F.round(amount, 2)).otherwise(amount), 2), F.lit(","), F.lit(""))
    text = F.replace(shown, F.lit("."), F.lit(","))
    return F.when(amount.isNull(), "—").otherwise(
        F.concat(F.when((amount > 0) & (amount < 0.01), "<0,01").otherwise(text), F.lit(" $"))
    )


def date_text(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd"), F.lit(""))


def sku_price(sku: Column) -> Column:
    """USD per thousand calls, zero for free sources."""
    return F.coalesce(label(S.SKU_PRICE_PER_1000, sku), F.lit(0.0))
