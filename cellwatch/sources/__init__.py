"""Readers, writers and the file gate."""
