"""Operational complaints in reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules.reviews import REVIEW_PATTERNS

KEY = "business_id"


def signals(reviews: DataFrame) -> DataFrame:
    """One row per (review, pattern) that matches: a projection over the pattern list, no join."""
    text = F.coalesce("text", F.lit(""))
    cells = F.array_compact(F.array(*[
        F.when(
            T.has(text, p.pattern),
            F.struct(
                F.lit(i).alias("place"), F.lit(p.category).alias("category"), F.lit(p.label).alias("label"),
                F.lit(p.confidence).alias("base_confidence"), F.lit(p.strong).alias("strong"),
                T.truncate(T.match_snippet(text, p.pattern, 60), 160).alias("evidence"),
            ),
        )
        for i, p in enumerate(REVIEW_PATTERNS)
    ]))
    return reviews.select(*[c for c in reviews.columns if c != "text"], F.inline(cells))


def review_findings(found: DataFrame, evidence: int = 3) -> DataFrame:
    """One finding per business and complaint. Evidence keeps the first few texts through bounded partial minima."""
    agg = found.groupBy(KEY, "place", "category", "label", "base_confidence", "strong").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"),
    )
    # first texts per group; the row limit is pushed ahead of the shuffle
    w = Window.partitionBy(KEY, "category").orderBy("seq", "review_id")
    first = (
        found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= evidence)
        .groupBy(KEY, "category").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "evidence"))), lambda e: e["evidence"]), " | ").alias("evidence"))
    )
    confidence = F.when(F.col("n") >= 2, "HIGH").when(F.col("base_confidence") == "HIGH", "MEDIUM").otherwise("LOW")
    return agg.join(first, [KEY, "category"]).select(
        KEY,
        (F.lit(500_000) + F.col("first_seq") * 100 + F.col("place")).cast("bigint").alias("seq"),
        F.concat(F.lit("REVIEW_"), F.col("category")).alias("code"),
        F.lit("REVIEWS").alias("category"),
        F.when(F.col("strong"), "MEDIUM").otherwise("LOW").alias("severity"),
        F.lit("INFERRED").alias("provenance"),
        confidence.alias("confidence"),
        F.concat(F.lit("Reseñas: "), F.lower("label"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("title"),
        F.lit(
            "Señal secundaria extraída de reseñas públicas: una reseña no demuestra por sí sola que la información "
            "online sea incorrecta."
        ).alias("description"),
        "evidence",
    )


def reviews_analyzed(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(KEY).agg(F.count("*").alias("reviews_analyzed"))

