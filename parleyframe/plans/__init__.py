"""Whole jobs over a corpus."""
