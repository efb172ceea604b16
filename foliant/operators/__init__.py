"""Relational operators over the corpus tables, as DataFrame transformations."""
