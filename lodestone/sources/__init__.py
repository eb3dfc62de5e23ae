"""The index on disk."""
