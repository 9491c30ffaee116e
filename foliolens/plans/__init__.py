"""Plans of foliolens."""
