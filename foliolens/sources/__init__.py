"""Sources of foliolens."""
