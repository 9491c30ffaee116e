"""Functions of foliolens."""
