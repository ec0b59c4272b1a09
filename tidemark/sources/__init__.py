"""Readers of bars and ticks, and writers of artifacts."""
