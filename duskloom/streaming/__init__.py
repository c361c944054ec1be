"""Restoring values in streams of text chunks."""
