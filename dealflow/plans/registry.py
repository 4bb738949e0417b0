"""All queries outside the llm subpackage, and their SQL twins."""

from . import grid_queries, quality_queries, report_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (report_queries, quality_queries, grid_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
