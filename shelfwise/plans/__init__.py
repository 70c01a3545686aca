"""Query catalogue, DuckDB oracle text, and plan-shape checks."""
