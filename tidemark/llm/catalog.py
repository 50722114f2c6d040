"""All queries of this package and their SQL."""

from __future__ import annotations

from tidemark.llm import (
    q_bm25, q_bpe, q_decontaminate, q_html_text, q_language_id, q_merkle, q_ngram_join, q_periodic_runs, q_preference, q_quality,
    q_segment_bpe, q_token_files,
)

_MODULES = (
    q_decontaminate, q_ngram_join, q_html_text, q_bpe, q_language_id, q_quality, q_token_files, q_preference, q_bm25, q_segment_bpe,
    q_periodic_runs, q_merkle,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
