"""Operators for preparing training data: one module for each, and `queries` that applies them to the tables."""
