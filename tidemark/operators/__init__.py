"""Operators over domain views."""
