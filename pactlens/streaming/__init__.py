"""Structured Streaming: the batch functions on arriving documents."""
