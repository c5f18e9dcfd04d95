"""Column functions, each with its DuckDB text."""
