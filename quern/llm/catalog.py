"""The training-data queries and their oracles."""

from __future__ import annotations

from . import (
    best_fit_packing,
    chat_format,
    embedding_near_dedup,
    embedding_whitening,
    exact_top_k,
    line_dedup,
    lm_scoring,
    merkle_manifest,
    quality_classifier,
    sentencepiece_codec,
    simhash_near_dedup,
    substring_dedup,
    toxicity,
)

MODULES = (sentencepiece_codec, lm_scoring, exact_top_k, toxicity, best_fit_packing, line_dedup, simhash_near_dedup, substring_dedup, quality_classifier, embedding_near_dedup, merkle_manifest, chat_format, embedding_whitening)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
