"""Readers, writers and mappings from tables and text to triples."""
