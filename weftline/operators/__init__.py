"""Dataflow operators as functions from DataFrame to DataFrame."""
