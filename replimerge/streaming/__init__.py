"""Structured Streaming forms of the operators that follow events."""
