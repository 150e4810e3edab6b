"""API usage counters and their estimated cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import sku_price


def merged(usage: DataFrame) -> DataFrame:
    """Calls per scan and SKU; a partial sum, so one busy scan collapses before the shuffle."""
    return usage.groupBy("scan_id", "sku").agg(F.sum("n").alias("n"))


def cost(usage: DataFrame) -> DataFrame:
    """Estimated USD per scan, four decimals."""
    return usage.groupBy("scan_id").agg(
        F.round(F.sum(sku_price(F.col("sku")) * F.col("n")) / 1000, 4).alias("estimated_cost_usd")
    )


def as_maps(usage: DataFrame) -> DataFrame:
    """One SKU -> calls map per scan; SKUs are a short fixed list."""
    return merged(usage).groupBy("scan_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sku", "n"))).alias("api_usage")
    )
