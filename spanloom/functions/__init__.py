"""Functions of the span engine."""
