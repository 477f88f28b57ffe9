"""Views and readers."""
