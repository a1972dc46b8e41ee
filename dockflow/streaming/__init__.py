"""Structured Streaming: the batch-completeness gate and its sink."""
