"""Structured Streaming forms of the evolution and gate operators."""
