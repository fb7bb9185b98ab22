"""Relational operators of the reconciliation engine."""
