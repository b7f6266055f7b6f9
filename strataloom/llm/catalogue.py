"""All queries of the subpackage, by name."""

from __future__ import annotations

from strataloom.llm import conversation_queries, entity_queries, pii_queries, residue_queries, subject_queries, token_queries

MODULES = [conversation_queries, entity_queries, pii_queries, residue_queries, token_queries, subject_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
