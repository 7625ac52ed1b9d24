"""Relational operators; each module documents the rows it returns for dirty input."""
