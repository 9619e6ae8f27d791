"""Whole queries: the subgraph pipeline, renderers, the graph of the supplied tables and the query catalogue."""
