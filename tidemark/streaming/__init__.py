"""Structured Streaming: bars from a stream of ticks."""
