"""Stage compositions, the query registry and the DuckDB oracle formulations."""
