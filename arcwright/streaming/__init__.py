"""Incremental maintenance of a stored graph from a stream of changes."""
