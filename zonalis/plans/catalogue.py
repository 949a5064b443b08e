"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from zonalis.plans import image_queries, measure_queries, text_queries

QUERIES = text_queries.QUERIES | measure_queries.QUERIES | image_queries.QUERIES
ORACLE_SQL = text_queries.ORACLE_SQL | measure_queries.ORACLE_SQL | image_queries.ORACLE_SQL
