"""Joins, windows, pricing, geography and quality rules as DataFrame functions."""
