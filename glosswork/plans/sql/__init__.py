"""The catalogue's queries as SQL for DuckDB."""
