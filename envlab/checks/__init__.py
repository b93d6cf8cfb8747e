"""SQL twins (DuckDB dialect) of the registered queries, and a comparison helper."""
