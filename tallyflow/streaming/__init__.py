"""Structured Streaming jobs over the same transforms the batch queries use."""
