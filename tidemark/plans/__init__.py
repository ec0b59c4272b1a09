"""Query catalogue and the walk-forward pipeline."""
