"""Structured Streaming: the clean and mask expressions applied to an unbounded input."""
