"""Score weights as a small table of rules: (kind, key, place, points), compiled into constants of the plan.

A rule replaces the built-in points of its kind and key, or adds a key where the kind takes any (consistency and review codes, presence
counts). The table is read once, when a query is built, and never joined: its size is checked, so it stays a handful of literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import lookup
from ..rules import scoring as S

MOST_RULES = 1000
OPEN_KINDS = ("consistency", "review", "presence")
REST = "*"


def default_rules() -> list[tuple[str, str, int, float]]:
    """The built-in weights as rules."""
    kinds = {
        "severity": S.WEB_POINTS,
        "cap": {"WEB_FUNCIONAL_CON_PROBLEMAS": S.WEB_PROBLEMS_CAP, "WEB_ACEPTABLE": S.WEB_ACCEPTABLE_CAP,
                "consistency": S.CONSISTENCY_MAX, "review": S.REVIEWS_MAX, "website": S.WEB_MAX},
        "status": {"SIN_WEB": S.WEB_NONE, "WEB_CAIDA": S.WEB_DOWN},
        "consistency": S.CONSISTENCY_POINTS,
        "review": {**dict.fromkeys(S.STRONG_REVIEW_CODES, S.REVIEW_STRONG_POINTS), REST: S.REVIEW_WEAK_POINTS},
        "presence": {str(low): points for low, points in S.PRESENCE_TIERS},
        "contact": {"phone": S.CONTACT_PHONE, "email": S.CONTACT_EMAIL, "form_or_chat": S.CONTACT_FORM_OR_CHAT},
        "need": {"booking": S.NEED_BOOKING, "menu": S.NEED_MENU},
        "penalty": {"CLOSED_TEMPORARILY": S.TEMPORARILY_CLOSED},
        "level": {"HIGH": S.LEVEL_HIGH, "MEDIUM": S.LEVEL_MEDIUM, "confidence": S.MIN_CONFIDENCE},
    }
    return [(kind, key, i, float(v)) for kind, keys in kinds.items() for i, (key, v) in enumerate(keys.items())]


@dataclass(frozen=True)
class Weights:
    """Points and places by (kind, key)."""

    rules: dict[tuple[str, str], tuple[int, float]] = field(
        default_factory=lambda: {(k, key): (place, points) for k, key, place, points in default_rules()})

    def points(self, kind: str, key: str) -> float:
        return self.rules[kind, key][1]

    def of(self, kind: str) -> dict[str, float]:
        """Points of a kind's keys by place."""
        keys = sorted((place, key) for (k, key), (place, _) in self.rules.items() if k == kind)
        return {key: self.points(kind, key) for _, key in keys}

    def places(self, kind: str) -> dict[str, int]:
        return {key: place for (k, key), (place, _) in self.rules.items() if k == kind}

    def by(self, kind: str, key: Column) -> Column:
        """Points for the key in a column, NULL for a key without a rule."""
        return lookup(self.of(kind), key)

    def tier(self, kind: str, count: Column) -> Column:
        """Points of the highest tier that ``count`` reaches, else 0."""
        out = F.when(F.lit(False), F.lit(0.0))
        for low, points in sorted(((int(k), v) for k, v in self.of(kind).items()), reverse=True):
            out = out.when(count >= low, F.lit(points))
        return out.otherwise(F.lit(0.0))


def load(rules: DataFrame) -> Weights:
    """Weights with the rules of a table; refuses tables that are too long, repeat a key or hold what no rule can mean."""
    rows = rules.select("kind", "key", "place", F.col("points").cast("double").alias("points")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    known = Weights().rules
    kinds = {kind for kind, _ in known}
    found: dict[tuple[str, str], tuple[int, float]] = {}
    for kind, key, place, points in rows:
        if None in (kind, key, place, points) or not math.isfinite(points):
            raise ValueError(f"rule without a value: {kind}, {key}, {place}, {points}")
        if (kind, key) in found:
            raise ValueError(f"two rules for {kind}, {key}")
        if kind not in kinds or (kind not in OPEN_KINDS and (kind, key) not in known):
            raise ValueError(f"no such rule: {kind}, {key}")
        if kind == "presence" and not key.isdecimal():
            raise ValueError(f"not a number of reviews: {key}")
        found[kind, key] = (place, points)
    return Weights({**known, **found})
