"""From searched areas to a worklist: categories, geography, sampling, official-site search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import url as U
from ..functions.literals import literal_array
from ..functions.text import let
from ..rules.categories import CATEGORIES
from ..rules.platforms import SEARCH_IGNORE_DOMAINS

CELL_DEGREES = 0.05
PAGE_SIZE = 20
RINGS = 1024


def split_request(categories: Column, all_categories: Column) -> Column:
    """struct<known, free_text>: nothing asked for, or everything, means the whole catalogue."""
    keys = F.array(*[F.lit(c.key) for c in CATEGORIES])
    known = F.array_intersect(categories, keys)
    free = F.array_except(categories, keys)
    everything = all_categories | ((F.size(known) == 0) & (F.size(free) == 0))
    return F.struct(
        F.when(everything, keys).otherwise(known).alias("known"),
        F.when(all_categories, F.array().cast("array<string>")).otherwise(free).alias("free_text"),
    )


def infer_category(types: Column, hint: Column | None = None) -> Column:
    """First catalogue entry sharing a type with the place; a valid hint goes first."""
    by_type = F.coalesce(*[
        F.when(F.arrays_overlap(types, literal_array(c.place_types)), F.lit(c.key))
        for c in CATEGORIES
    ])
    if hint is None:
        return by_type
    return F.when(hint.isin([c.key for c in CATEGORIES]), hint).otherwise(by_type)


def tag_category(tags: Column) -> Column:
    """First catalogue tag filter that matches."""
    return F.coalesce(*[
        F.when(tags[key].rlike(pattern), F.lit(c.key)) for c in CATEGORIES for key, pattern in c.tag_filters
    ])


def _cell(deg: Column) -> Column:
    return F.floor(deg / CELL_DEGREES).cast("bigint")


def within_radius(places: DataFrame, areas: DataFrame) -> DataFrame:
    """Places of each circle (area_id, lat, lng, radius_m) with their distance.

    Circles are laid out on a grid and joined to places by cell, so no place meets a far-away circle; a crowded cell
    is an ordinary skewed join key, which adaptive execution splits.
    """
    d_lat, d_lng = G.lat_span(F.col("radius_m")), G.lng_span(F.col("radius_m"), F.col("lat"))
    cells = (
        areas.withColumn("cy", F.explode(F.sequence(_cell(F.col("lat") - d_lat), _cell(F.col("lat") + d_lat))))
        .withColumn("cx", F.explode(F.sequence(_cell(F.col("lng") - d_lng), _cell(F.col("lng") + d_lng))))
        .select("area_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), "radius_m", "cy", "cx")
    )
    located = places.where("lat is not null and lng is not null").withColumns(
        {"cy": _cell(F.col("lat")), "cx": _cell(F.col("lng"))}
    )
    distance = G.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng"))
    return (
        located.join(cells, ["cy", "cx"])
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= F.col("radius_m"))
        .drop("cy", "cx", "a_lat", "a_lng")
    )


def near_rings(hits: DataFrame, most_rows: DataFrame, max_results: int) -> DataFrame:
    """The hits of :func:`within_radius` from the innermost rings of each circle that surely hold ``max_results`` places.

    Rings of equal area are counted first, a small aggregate, so the rows left to sort do not grow with the crowd in a circle.
    ``most_rows`` has one row with the number ``m`` of hits that one place can have in one area at most.
    """
    share = F.coalesce(F.try_divide("distance_m", "radius_m"), F.lit(0.0))
    ringed = hits.withColumn("ring", F.floor(RINGS * share * share))
    inside = Window.partitionBy("area_id").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    counts = ringed.groupBy("area_id", "ring").count().withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    last = counts.join(most_rows, F.col("inside") < max_results * F.col("m")).groupBy(F.col("area_id").alias("_area")).agg(F.max("ring").alias("_last"))
    return ringed.join(F.broadcast(last), F.col("area_id").eqNullSafe(F.col("_area")) & (F.col("ring") <= F.col("_last"))).drop("ring", "_area", "_last")


def nearest(places: DataFrame, areas: DataFrame, max_results: int, id_col: str = "business_id") -> DataFrame:
    """Closest places of each area, each place once; only the innermost rings of a circle are gathered and sorted."""
    most = lambda df, key, name: df.select(key).repartition(key).groupBy(key).count().agg(F.max("count").alias(name))
    most_rows = most(places, id_col, "_p").crossJoin(most(areas, "area_id", "_a")).select((F.col("_p") * F.col("_a")).alias("m"))
    hits = near_rings(within_radius(places, areas), most_rows, max_results).dropDuplicates(["area_id", id_col])
    w = Window.partitionBy("area_id").orderBy("distance_m", id_col)
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_results)


def interleave(hits: DataFrame, max_results: int, max_requests: int | None = None) -> DataFrame:
    """Fair sample over queries: one result page per query and round, nearest tile first, each place once.

    Input (query_idx, tile_idx, rank, place_id, ...) with ``rank`` counted from 1 inside a tile. Rounds follow from
    page counts per (query, tile), a small aggregate; the sample itself is a top-k.
    """
    pages = hits.groupBy("query_idx", "tile_idx").agg(
        F.ceil(F.max("rank") / PAGE_SIZE).alias("pages")
    )
    before = Window.partitionBy("query_idx").orderBy("tile_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select(
        "query_idx", "tile_idx", F.coalesce(F.sum("pages").over(before), F.lit(0)).alias("first_round")
    )
    rounds = hits.join(starts, ["query_idx", "tile_idx"]).withColumn(
        "round", (F.col("first_round") + F.floor((F.col("rank") - 1) / PAGE_SIZE)).cast("bigint")
    )
    at = F.struct("round", "query_idx", "rank", "tile_idx")
    if max_requests is not None:
        # requests are numbered round by round; only the first ones are sent
        sent = rounds.select("round", "query_idx").distinct().orderBy("round", "query_idx").limit(max_requests)
        rounds = rounds.join(sent, ["round", "query_idx"], "left_semi")
    cols = [c for c in hits.columns if c not in ("place_id",)]
    first = rounds.groupBy("place_id").agg(F.min_by(F.struct("round", *cols), at).alias("h"))
    flat = first.select("place_id", "h.*")
    return flat.orderBy("round", "query_idx", "rank", "tile_idx").limit(max_results)


def worklist(found: DataFrame, business: DataFrame, jobs: DataFrame, as_of: Column, reuse_hours: int = 24) -> DataFrame:
    """Businesses of a scan still to analyse: not analysed lately (unless fresh reviews came) and not queued."""
    cutoff = as_of - F.expr(f"interval {reuse_hours} hours")
    rows = found.join(business.select("business_id", "last_analyzed_at"), "business_id")
    reused = F.coalesce((F.col("last_analyzed_at") > cutoff) & ~F.col("has_reviews"), F.lit(False))
    return rows.where(~reused).join(jobs.select("scan_id", "business_id"), ["scan_id", "business_id"], "left_anti")


def _ignored(host: Column, domain: Column) -> Column:
    """Directories, marketplaces and news sites: the domain itself or any host below a listed name."""
    parents = let(U.host_suffixes(host), lambda s: F.slice(s, 2, F.size(s)))
    return domain.isin(SEARCH_IGNORE_DOMAINS) | F.arrays_overlap(
        parents, literal_array(SEARCH_IGNORE_DOMAINS)
    )


def official_site(hits: DataFrame, max_candidates: int = 3) -> DataFrame:
    """Verified own website among ranked search hits (business_id, rnk, url, phone_match, name_coverage,
    location_hit, readable).

    A provider returns a handful of hits per business, so the windows stay small.
    """
    parts = U.parse(F.col("url"))
    rows = hits.select("*", parts.alias("u")).where("u is not null")
    rows = rows.withColumns({
        "host": F.col("u.host"),
        "domain": U.registrable_domain(F.col("u.host")),
        "kind": U.platform(F.col("u.host"), F.col("u.path"))["kind"],
    })
    first_of_domain = F.row_number().over(Window.partitionBy("business_id", "domain").orderBy("rnk")) == 1
    usable = rows.withColumn("first", first_of_domain).where(
        F.col("first") & ~_ignored(F.col("host"), F.col("domain"))
        & (F.col("kind").isNull() | (F.col("kind") == "FREE_SUBDOMAIN_BUILDER"))
    )
    by_name = (F.col("name_coverage") >= 0.6) & F.col("location_hit")
    verification = F.when(
        F.col("readable"), F.when(F.col("phone_match"), "phone").when(by_name, "name_location")
    )
    before = Window.partitionBy("business_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, -1)
    judged = usable.withColumn("verification", verification).withColumns({
        "failed_before": F.count_if(F.col("verification").isNull()).over(before),
        "found_before": F.count_if(F.col("verification").isNotNull()).over(before),
    })
    looked_at = judged.where((F.col("failed_before") < max_candidates) & (F.col("found_before") == 0))
    hit = F.col("verification").isNotNull()
    return looked_at.groupBy("business_id").agg(
        F.max(F.when(hit, F.col("url"))).alias("url"),
        F.max("verification").alias("verification"),
        F.count_if(~hit).alias("unverified"),
    )
