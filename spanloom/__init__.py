"""Span analytics on Spark: declarative DataFrame operators over documents and typed character spans."""
