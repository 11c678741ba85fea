"""Operators of the span engine."""
