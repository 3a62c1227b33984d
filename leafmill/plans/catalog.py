"""All queries of the page-analysis operators and their SQL."""

from __future__ import annotations

from leafmill.plans import model_queries, page_queries, registry, repair_queries, report_queries, store_queries, text_queries  # noqa: F401  importing registers

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
