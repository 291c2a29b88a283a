"""Structured Streaming forms of the layer jobs."""
