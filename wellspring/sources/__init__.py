"""Readers, writers and text parsers."""
