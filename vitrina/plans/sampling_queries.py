"""Fair place samples per scan: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SA
from .registry import query

HITS = "fx_scan_hit"
WANTED, BUDGET = 150, 90

_WALK = f"""
asked as (select scan_id, query_idx, tile_idx, greatest(1, coalesce(max(rank), 1) + 19) // 20 as pages from
 (select scan_id, query_idx, tile_idx, rank from fx_scan_hit union all select distinct scan_id, query_idx, t.i, null from fx_scan_hit, (values (0), (1), (2), (3)) as t(i)) group by 1, 2, 3),
walk as (select *, coalesce(sum(pages) over (partition by scan_id, query_idx order by tile_idx rows between unbounded preceding and 1 preceding), 0) as first_round from asked),
req as (select *, row_number() over (partition by scan_id order by round, query_idx) - 1 as number from (select scan_id, query_idx, unnest(generate_series(first_round::bigint, (first_round + pages - 1)::bigint)) as round from walk)),
seen as (select h.*, first_round::bigint + (rank - 1) // 20 as round from fx_scan_hit h join walk using (scan_id, query_idx, tile_idx) where inside),
firsts as (select * from (select s.*, number, row_number() over (partition by scan_id, place_id order by round, query_idx, rank) as nth from seen s join req using (scan_id, round, query_idx) where number < {BUDGET}) where nth = 1),
placed as (select *, row_number() over (partition by scan_id order by number, rank, place_id) as position from firsts)
"""


def _asked(hits):
    """Every query of a scan asks the four tiles from 0 to 3, with or without hits."""
    return hits.select("scan_id", "query_idx").distinct().withColumn("tile_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))


def _arguments(t):
    return {"budget": BUDGET, "asked": _asked(t[HITS]), "inside": "inside"}


@query("scan_fair_sample", (HITS,), f"""
select scan_id, position, place_id, round, query_idx, tile_idx, rank from placed where position <= {WANTED}""", _WALK)
def scan_fair_sample(t):
    return SA.fair_sample(t[HITS], WANTED, **_arguments(t))


@query("scan_request_usage", (HITS,), f"""
select scan_id, requests, least(found, {WANTED})::bigint as found, found < {WANTED} and total > {BUDGET} as budget_reached from (
 select scan_id, count(*) as total, coalesce(max(f.found), 0) as found, least({BUDGET}, count(*), coalesce(max(f.stop) + 1, count(*)))::bigint as requests
 from req left join (select scan_id, count(*) as found, max(number) filter (where position = {WANTED}) as stop from placed group by 1) f using (scan_id) group by 1)""", _WALK)
def scan_request_usage(t):
    return SA.request_usage(t[HITS], WANTED, **_arguments(t))
