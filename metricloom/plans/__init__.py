"""The registered queries and their DuckDB twins."""
