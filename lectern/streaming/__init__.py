"""Structured Streaming forms of the progress, queue and boundary operators."""
