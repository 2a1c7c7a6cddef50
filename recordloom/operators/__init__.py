"""Relational operators of business records: policies, lists, joins, folds and decisions."""
