"""Rule tables written out as SQL literals for the SQL checks."""

from __future__ import annotations

from ..rules.categories import CATEGORIES


def lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v}::double"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def quoted(items) -> str:
    return ", ".join(lit(i) for i in items)


def category_values() -> str:
    return values([(c.key, c.label_es, c.needs_booking, c.needs_menu) for c in CATEGORIES])
