"""Fair samples of place searches: every scan asks its queries in turn, page by page, tile by tile.

A scan has several queries; each walks through its tiles, nearest first, and takes one result page per round. A request
is (scan_id, round, query_idx); within a scan requests are sent round by round, queries in their order. Places count once per
scan, those outside the searched circle not at all. A scan stops at its wanted number of places or at its request budget.

Rows without scan, query, tile, rank or place are left out, and so are repeats of a hit. Ranks start at 1 in each tile; a page
holds ``page_size`` of them. The same place twice on one page counts at its first rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_before

SCAN = "scan_id"
PAGE_SIZE = 20
STRETCH = 1024
_CURSOR = [SCAN, "query_idx"]
_REQUEST = [SCAN, "round", "query_idx"]


def tile_rounds(hits: DataFrame, asked: DataFrame | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """(scan_id, query_idx, tile_idx, pages, first_round): the rounds in which a query is at a tile.

    ``asked`` (scan_id, query_idx, tile_idx) names every tile of a query: one without hits still takes a request.
    """
    tiles = hits.select(*_CURSOR, "tile_idx", F.ceil(F.col("rank") / page_size).cast("bigint").alias("pages"))
    if asked is not None:
        tiles = tiles.unionByName(asked.select(*_CURSOR, "tile_idx", F.lit(1).cast("bigint").alias("pages")).dropna())
    tiles = tiles.groupBy(*_CURSOR, "tile_idx").agg(F.max("pages").alias("pages"))
    return running_before(tiles, _CURSOR, ["tile_idx"], "pages", F.floor(F.col("tile_idx") / STRETCH), "first_round")


def requests(rounds: DataFrame) -> DataFrame:
    """(scan_id, round, query_idx, number): every request there is to send, numbered from 0 in each scan."""
    asked = rounds.select(
        *_CURSOR, F.explode(F.sequence("first_round", F.col("first_round") + F.col("pages") - 1)).alias("round"),
        F.lit(1).alias("one"))
    numbered = running_before(asked, [SCAN], ["round", "query_idx"], "one", F.floor(F.col("round") / STRETCH), "number")
    return numbered.select(*_REQUEST, "number")


def _places(hits: DataFrame, rounds: DataFrame, budget: int | None, inside: str | None, page_size: int) -> tuple[DataFrame, DataFrame]:
    """(requests within the budget with the new places found before each, first sighting of every place)."""
    sent = requests(rounds)
    if budget is not None:
        sent = sent.where(F.col("number") < budget)
    seen = hits.join(rounds, [*_CURSOR, "tile_idx"]).withColumn(
        "round", F.col("first_round") + F.floor((F.col("rank") - 1) / page_size))
    if inside is not None:
        seen = seen.where(F.col(inside))
    if budget is not None:
        seen = seen.join(sent.select(*_REQUEST), _REQUEST, "left_semi")
    first = seen.groupBy(SCAN, "place_id").agg(F.min(F.struct("round", "query_idx", "rank", "tile_idx")).alias("at"))
    first = first.select(SCAN, "place_id", "at.*")
    new = first.groupBy(*_REQUEST).agg(F.count("*").alias("new"))
    counted = sent.join(new, _REQUEST, "left").fillna(0, ["new"])
    return running_before(counted, [SCAN], ["number"], "new", F.floor(F.col("number") / STRETCH), "before"), first


def _complete(hits: DataFrame) -> DataFrame:
    return hits.dropna(subset=[*_CURSOR, "tile_idx", "rank", "place_id"])


def fair_sample(hits: DataFrame, max_results: int, budget: int | None = None, asked: DataFrame | None = None,
                inside: str | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """(scan_id, position, place_id, round, query_idx, tile_idx, rank): the places each scan keeps, in the order they were found.

    ``hits`` (scan_id, query_idx, tile_idx, rank, place_id, and the boolean column that ``inside`` names) may hold any number of
    scans; one scan may hold most rows. ``max_results`` and ``budget`` count per scan.
    """
    hits = _complete(hits)
    sent, first = _places(hits, tile_rounds(hits, asked, page_size), budget, inside, page_size)
    on_page = Window.partitionBy(*_REQUEST).orderBy("rank", "place_id")
    placed = first.join(sent.where(F.col("before") < max_results).select(*_REQUEST, "before"), _REQUEST).withColumn(
        "position", F.col("before") + F.row_number().over(on_page))
    return placed.where(F.col("position") <= max_results).select(
        SCAN, "position", "place_id", "round", "query_idx", "tile_idx", "rank")


def request_usage(hits: DataFrame, max_results: int, budget: int | None = None, asked: DataFrame | None = None,
                  inside: str | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """(scan_id, requests, found, budget_reached): what each scan sends before it stops.

    ``budget_reached`` tells that the budget ended the scan while queries had pages left and places were still wanted.
    """
    hits = _complete(hits)
    rounds = tile_rounds(hits, asked, page_size)
    sent, _ = _places(hits, rounds, budget, inside, page_size)
    spent = sent.where(F.col("before") < max_results).groupBy(SCAN).agg(
        F.count("*").alias("requests"), F.max(F.col("before") + F.col("new")).alias("got"))
    total = rounds.groupBy(SCAN).agg(F.sum("pages").alias("pages"))
    left = (F.col("got") < max_results) & (F.col("pages") > F.col("requests"))
    return total.join(spent, SCAN, "left").fillna(0, ["requests", "got"]).select(
        SCAN, "requests", F.least("got", F.lit(max_results)).cast("bigint").alias("found"), left.alias("budget_reached"))
