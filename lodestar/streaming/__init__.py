"""Structured Streaming twins of the event operators."""
