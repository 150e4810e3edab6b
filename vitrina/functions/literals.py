"""Fixed tables as constant expressions, each built by one call however many entries it has."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, Mapping):
        return "named_struct(" + ", ".join(f"{sql_literal(k)}, {sql_literal(x)}" for k, x in v.items()) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: Mapping) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs.items()) + ")")


def literal_array(items: Iterable) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(i) for i in items) + ")")


def lookup(pairs: Mapping, key: Column) -> Column:
    """Value for ``key`` in a fixed table, NULL when it has none."""
    return literal_map(pairs)[key]
