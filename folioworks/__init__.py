"""Spark jobs for large document and bibliography corpora."""
