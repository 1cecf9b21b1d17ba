"""Whole jobs: exports, and the queries on the driver tables."""
