"""Dataflow operators over bars, ticks, candidates and labelled events."""
