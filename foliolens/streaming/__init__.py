"""Streaming of foliolens."""
