"""Structured Streaming forms of the feed operators."""
