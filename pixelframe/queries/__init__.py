"""Registered queries, each with the SQL that DuckDB must agree with."""
