"""Structured Streaming forms of the operators that read arriving files."""
