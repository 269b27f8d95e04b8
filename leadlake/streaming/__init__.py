"""Structured Streaming readers and appliers over the batch operators."""
