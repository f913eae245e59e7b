"""Joins, and collections and databases with their writes and commands."""
