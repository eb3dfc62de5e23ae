"""Every query of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from lodestone.llm import (
    queries_embeddings,
    queries_language,
    queries_licenses,
    queries_minhash,
    queries_packing,
    queries_pii,
    queries_quality,
    queries_substrings,
    queries_tokens,
)

_MODULES = (queries_substrings, queries_minhash, queries_packing, queries_language, queries_embeddings, queries_quality, queries_licenses, queries_tokens, queries_pii)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
