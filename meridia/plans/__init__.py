"""Operators bound to tables."""
