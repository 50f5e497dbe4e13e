"""Structured Streaming forms of the index operators."""
