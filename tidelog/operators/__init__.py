"""Operators on object logs."""
