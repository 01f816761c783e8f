"""Queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""
