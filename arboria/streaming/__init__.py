"""File watching and incremental indexing."""
