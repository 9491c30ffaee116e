"""Foliolens: corpus-scale analytics over scholarly documents, on PySpark."""
