"""All queries of the core, by name."""

from __future__ import annotations

from strataloom.plans import checks, data_quality, files, graphs, rankings, reviews, texts

MODULES = [data_quality, texts, files, rankings, graphs, checks, reviews]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
