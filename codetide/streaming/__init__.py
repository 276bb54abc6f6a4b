"""Structured Streaming forms of the event and index operators."""
