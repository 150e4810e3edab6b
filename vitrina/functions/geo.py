"""Distances, boxes and tilings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def lat_span(radius_m: Column) -> Column:
    return F.degrees(radius_m / EARTH_RADIUS_M)


def lng_span(radius_m: Column, lat: Column) -> Column:
    return lat_span(radius_m) / F.cos(F.radians(lat))


def tile_circles(areas: DataFrame, tile_radius_m: float) -> DataFrame:
    """Cover each circle (area_id, lat, lng, radius_m) by overlapping tiles, centre first.

    Small circles stay one tile. Tiles per circle grow with its area only, so the rows are made in place.
    """
    step = tile_radius_m * math.sqrt(2)
    small = F.col("radius_m") <= tile_radius_m * 1.2
    n = F.when(small, F.lit(0)).otherwise(F.ceil(F.col("radius_m") / step).cast("int"))
    lat_step = math.degrees(step / EARTH_RADIUS_M)
    grid = (
        areas.withColumn("n", n)
        .withColumn("i", F.explode(F.sequence(-F.col("n"), F.col("n"))))
        .withColumn("j", F.explode(F.sequence(-F.col("n"), F.col("n"))))
        .withColumn("tile_lat", F.col("lat") + F.col("i") * lat_step)
        .withColumn("tile_lng", F.col("lng") + F.col("j") * (lat_step / F.cos(F.radians("lat"))))
        .withColumn(
            "distance_m",
            haversine_m(F.col("lat"), F.col("lng"), F.col("tile_lat"), F.col("tile_lng")),
        )
    )
    inside = small | (F.col("distance_m") <= F.col("radius_m") + tile_radius_m * 0.5)
    return grid.where(inside).select(
        "area_id", "i", "j", "tile_lat", "tile_lng",
        F.when(small, F.col("radius_m")).otherwise(F.lit(tile_radius_m)).alias("tile_radius_m"),
        "distance_m",
    )
