"""Operators that prepare text for training: filters, joins, counts and mixing over document tables."""
