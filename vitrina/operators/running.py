"""Running sums and dense numbers over long sequences, in two levels, so that no sequence is sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(rows: DataFrame, key: list[str], order: list[str], value: str, stretch: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same key that come earlier in ``order``.

    ``stretch`` cuts a key's sequence into consecutive stretches: it never falls along ``order``. Rows are only sorted inside
    a stretch; what lies before a stretch comes from sums per stretch. ``key`` and ``stretch`` are never NULL, ``order`` is
    total within a key.
    """
    cut = rows.withColumn("_stretch", stretch)
    sums = cut.groupBy(*key, "_stretch").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return cut.join(offsets, [*key, "_stretch"]).select(*rows.columns, total.cast("bigint").alias(name))
