"""Loads of newly arriving files as Structured Streaming jobs."""
