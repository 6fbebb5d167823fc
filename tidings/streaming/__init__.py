"""Structured Streaming versions of the batch operators."""
