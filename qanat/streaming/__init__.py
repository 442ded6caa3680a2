"""Structured Streaming jobs: drain the event source into bronze, publish the outbox, dedupe in flight."""
