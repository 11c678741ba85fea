"""Plans of the span engine."""
