"""Composed queries, with the same in SQL."""
