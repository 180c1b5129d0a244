"""Logical graphs of stages, their validation, rewriting and lowering."""
