"""DataFrame operators over the nodes and edges of a graph."""
