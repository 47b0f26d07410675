"""Readers of change data and of code graphs, and writers of graph scripts and reports."""
