"""Structured Streaming forms of the bar job."""
