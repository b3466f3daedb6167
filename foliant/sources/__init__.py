"""Stored collections: versioned Parquet with atomic pointers."""

from foliant.sources.collection import Collection, Cursor, Database

__all__ = ["Collection", "Cursor", "Database"]
