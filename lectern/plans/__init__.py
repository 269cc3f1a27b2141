"""Whole pipelines: reading photos, and evaluating readings."""
