"""Readers of files and of the test tables."""
