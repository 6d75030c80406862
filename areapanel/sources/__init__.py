"""Readers, writers and source contracts."""
