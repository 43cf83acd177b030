"""Sinks: exports, archives, forwards and notification texts."""
