"""Structured Streaming forms of the statistics and the sample."""
