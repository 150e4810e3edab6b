"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrina.llm import html_main, jaccard, langid, licenses, line_dedup, merkle, mixing, packing, prefix_trie
from vitrina.llm import ranked_search, token_count, toxicity, vector_dedup
from vitrina.llm.base import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over("documents", langid.classify),
    "op2_html_main_text": _over("pages", html_main.main_text),
    "op3_source_mixing": _over("documents", mixing.taken),
    "op4_line_dedup": _over("documents", line_dedup.digest),
    "op5_embedding_near_dedup": _over("embeddings", vector_dedup.groups),
    "op6_token_counts": _over("documents", token_count.counts),
    "op7_document_fingerprints": _over("documents", merkle.compare),
    "op8_packing": _over("documents", packing.pack),
    "op9_ngram_jaccard_join": _over("documents", jaccard.groups),
    "op10_license_scan": _over("documents", licenses.scan),
    "op11_conversation_trie": _over("conversations", prefix_trie.nodes),
    "op12_toxicity": lambda spark, sf_dir: toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_ranked_search": lambda spark, sf_dir: ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL, "op10_license_scan": licenses.sql(), "op11_conversation_trie": prefix_trie.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
