"""Readers and writers of the native file formats."""
