"""Streaming twins."""
