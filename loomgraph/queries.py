"""All queries over the code graph, and the SQL that states them."""

from __future__ import annotations

from .plans import graph_queries, job_queries, scalar_queries, table_queries

QUERIES = {**scalar_queries.QUERIES, **table_queries.QUERIES, **graph_queries.QUERIES, **job_queries.QUERIES}
ORACLE_SQL = {**scalar_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **job_queries.ORACLE_SQL}
