"""Readers of landed files and writers of stage outputs."""
