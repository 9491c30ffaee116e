"""Operators of foliolens."""
