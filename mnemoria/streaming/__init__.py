"""Structured Streaming forms of the operators whose input has no end."""
