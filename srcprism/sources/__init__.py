"""Readers and front-ends that produce fact tables."""
