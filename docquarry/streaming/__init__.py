"""Structured Streaming: an addition of this engine; the batch operators do the work."""
