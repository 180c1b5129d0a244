"""Graphs as Structured Streaming queries."""
