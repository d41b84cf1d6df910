"""Checks on frames as they arrive."""
