"""Operators over documents and segments."""
