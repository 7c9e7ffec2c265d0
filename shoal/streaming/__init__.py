"""Incremental (Structured Streaming) forms of the batch log analytics."""
