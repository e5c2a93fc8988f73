"""Relational operators, each DataFrame in and DataFrame out."""
