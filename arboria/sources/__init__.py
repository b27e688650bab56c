"""Scans of source trees, adapters of tables, and the versioned Parquet store."""
