"""Structured Streaming over events and graph changes."""
