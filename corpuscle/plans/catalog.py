"""All queries of the engine by name, with the SQL they are checked against."""

from __future__ import annotations

from corpuscle.plans import documents, media, native, registry, retrieval, search

QUERIES = retrieval.QUERIES | documents.QUERIES | registry.QUERIES | native.QUERIES | media.QUERIES | search.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | documents.ORACLE_SQL | registry.ORACLE_SQL | native.ORACLE_SQL | media.ORACLE_SQL | search.ORACLE_SQL
FLAGSHIP = retrieval.hybrid_hits
