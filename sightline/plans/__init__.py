"""Registered queries: each operator on tables derived from the driver's parquet files."""
