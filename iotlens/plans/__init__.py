"""Composed flows and the registered query catalog."""
