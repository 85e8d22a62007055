"""Whole runs: import and export."""
