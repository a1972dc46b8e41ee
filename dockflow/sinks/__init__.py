"""Immutable releases, serving exports and live publication."""
