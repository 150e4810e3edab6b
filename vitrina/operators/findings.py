"""Findings: union, dedupe, counts and the technical score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import scoring as S
from ..rules.findings import FINDINGS
from ..rules.vocab import CONSISTENCY_CATEGORIES, CONTENT_CATEGORIES, SEVERITIES, TECHNICAL_CATEGORIES

FIELDS = ["code", "category", "severity", "provenance", "confidence", "title", "description", "evidence"]


def rank_of(severity: Column) -> Column:
    """0 for the worst severity; the order is the vocabulary's, not the alphabet's."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def finding(
    code: str,
    severity: Column | str,
    *,
    title: Column | None = None,
    value: Column | None = None,
    evidence: Column | None = None,
    description: Column | None = None,
    confidence: Column | str = "HIGH",
    provenance: str = "ANALYZED",
    catalog_key: str | None = None,
) -> Column:
    """One finding struct. ``value`` fills the ``{}`` of the catalogue title."""
    category, text = FINDINGS[catalog_key or code]
    if title is None:
        before, _, after = text.partition("{}")
        title = F.concat(F.lit(before), value.cast("string"), F.lit(after)) if value is not None else F.lit(text)
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(category).alias("category"),
        as_col(severity).alias("severity"),
        F.lit(provenance).alias("provenance"),
        as_col(confidence).alias("confidence"),
        title.alias("title"),
        (description if description is not None else F.lit(None)).cast("string").alias("description"),
        (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence"),
    )


def emit(df: DataFrame, rules: list[tuple[Column, Column]], keys: list[str], base_seq: int = 0) -> DataFrame:
    """Rows of every rule whose condition holds: one projection over the wide row, no join.

    ``rules`` is a list of (condition, finding struct); ``seq`` keeps the rule order.
    """
    cells = F.array_compact(
        F.array(*[
            F.when(cond, F.struct(F.lit(base_seq + i).cast("bigint").alias("seq"), f.alias("f")))
            for i, (cond, f) in enumerate(rules)
        ])
    )
    rows = df.select(*keys, F.explode(cells).alias("r"))
    return rows.select(*keys, "r.seq", "r.f.*")


def union_all(*parts: DataFrame) -> DataFrame:
    """Findings of all passes; each part keeps its place through ``seq`` offsets set by its producer."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe(findings: DataFrame, key: str = "business_id") -> DataFrame:
    """Worst record per (business, code), placed where the code first appeared.

    Both aggregates combine before the shuffle, so repeats of one business collapse on the map side.
    """
    extra = [c for c in findings.columns if c not in (key, "code", "seq", "sev_rank")]
    ranked = findings.withColumn("sev_rank", rank_of(F.col("severity")))
    best = ranked.groupBy(key, "code").agg(
        F.min_by(F.struct("sev_rank", *extra), F.struct("sev_rank", "seq")).alias("b"),
        F.min("seq").alias("seq"),
    )
    return best.select(key, "code", "seq", "b.*")


def severity_counts(findings: DataFrame, key: str = "business_id") -> DataFrame:
    return findings.groupBy(key).agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    )


def technical_score(findings: DataFrame, key: str = "business_id") -> DataFrame:
    penalty = F.create_map(*[F.lit(x) for kv in S.TECHNICAL_PENALTY.items() for x in kv])[F.col("severity")]
    return findings.groupBy(key).agg(
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.sum(penalty))).cast("bigint").alias("technical_score")
    )


def issue_counts(findings: DataFrame, key: str = "business_id") -> DataFrame:
    real = F.col("severity") != "INFO"
    groups = {
        "technical_issue_count": TECHNICAL_CATEGORIES,
        "content_issue_count": CONTENT_CATEGORIES,
        "consistency_issue_count": CONSISTENCY_CATEGORIES,
    }
    return findings.groupBy(key).agg(
        *[F.count_if(real & F.col("category").isin(cats)).alias(name) for name, cats in groups.items()]
    )


def top_titles(findings: DataFrame, key: str, severities: list[str], limit: int, sep: str = " | ",
               skip_category: str | None = None) -> DataFrame:
    """First titles by severity as one text. Deduped findings, so a group holds at most one row per code."""
    keep = F.col("severity").isin(severities)
    if skip_category:
        keep = keep & (F.col("category") != skip_category)
    rows = findings.where(keep).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("sev_rank", "seq", "title"))).alias("rows")
    )
    return rows.select(
        key, F.array_join(F.transform(F.slice("rows", 1, limit), lambda r: r["title"]), sep).alias("titles")
    )
