"""Composed plans, synthetic views and the registered queries."""
