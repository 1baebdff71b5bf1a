"""Queries over the sample tables, each with the SQL it must agree with."""
