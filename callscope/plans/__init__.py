"""Queries over a code graph, and the graph itself."""
