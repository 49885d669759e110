"""Structured Streaming forms of the pyramid operators."""
