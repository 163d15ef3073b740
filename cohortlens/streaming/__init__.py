"""Windowed forms of the mergeable aggregates."""
