"""Structured Streaming jobs over the live order feed."""
