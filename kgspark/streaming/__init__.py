"""Structured Streaming jobs on triples."""
