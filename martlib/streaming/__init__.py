"""Structured Streaming: validated, deduplicated and counted events."""
