"""Stage tables: expensive intermediates written once to the shared folder and read back.

Page parsing feeds many later steps. Writing its result cuts the lineage, lets each later step read only the columns
it needs, and survives the loss of executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import scratch_path

_WRITTEN: dict[tuple[str, str, str], str] = {}


def staged(tables, name: str, build: Callable[[], DataFrame], *columns: str) -> DataFrame:
    """The stage table, or only ``columns`` of it: they are taken from the whole table where an earlier step wrote it, else
    they alone are computed and written."""
    spark = tables.spark
    key = (spark.sparkContext.applicationId, tables.sf_dir, name)
    if columns and key not in _WRITTEN:
        key = (*key[:2], f"{name}-{'-'.join(columns)}")
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        (build().select(*columns) if columns else build()).write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    found = spark.read.parquet(_WRITTEN[key])
    return found.select(*columns) if columns else found
