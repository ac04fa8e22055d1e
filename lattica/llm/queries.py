"""The queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from . import centroid_clustering, chat_format, document_fingerprints, html_extraction, mixing, pii, prefix_trie, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, substring_dedup, topk_search

MODULES = [quality_rules, chat_format, sentencepiece_codec, topk_search, substring_dedup, mixing, pii, quality_classifier, html_extraction, simhash_dedup, prefix_trie, document_fingerprints, centroid_clustering]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
