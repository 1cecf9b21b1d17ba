"""Readers of landed data and the stored tables."""
