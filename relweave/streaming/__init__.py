"""Append-only logs read as they grow."""
