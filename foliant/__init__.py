"""Foliant: versioned structured documents as Spark tables."""
