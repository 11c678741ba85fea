"""Streaming of the span engine."""
