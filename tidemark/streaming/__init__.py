"""Structured Streaming versions of the batching operators."""
