"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from leafmill.llm import alignment, chat, decontamination, exact_dedup, language, near_dedup, packing, phrases, pieces, quality, sharding, suffix_dedup, toxicity

MODULES = (language, toxicity, suffix_dedup, chat, sharding, quality, exact_dedup, decontamination, near_dedup, pieces, phrases, alignment, packing)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
