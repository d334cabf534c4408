"""Readers and writers: array files, Markdown, SQLite, nested JSON."""
