"""Sources of the span engine."""
