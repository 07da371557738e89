"""All registered queries and their DuckDB equivalents."""

from .queries import catalog, pages, rewrites, sequences, shapes, texts

THEMES = (catalog, rewrites, sequences, texts, pages, shapes)
QUERIES = {name: query for theme in THEMES for name, query in theme.QUERIES.items()}
ORACLE_SQL = {name: sql for theme in THEMES for name, sql in theme.ORACLE_SQL.items()}
