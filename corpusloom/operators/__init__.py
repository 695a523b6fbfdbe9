"""Relational forms of the corpus operators."""
