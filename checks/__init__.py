"""Queries over the given tables, each with the equivalent SQL where SQL can say it."""
