"""Streams of document events."""
