"""Streaming of the evaluation engine."""
