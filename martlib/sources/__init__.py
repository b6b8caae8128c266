"""Readers, writers and the lake catalogue."""
