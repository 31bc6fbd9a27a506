"""Operators composed to whole flows."""
