"""Operators on code graphs: classification, traversal, trees, weights, reports."""
