"""Operators: DataFrames in, DataFrame out, keyed by ``episode_id``."""
