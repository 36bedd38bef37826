"""Readers, writers and contract checks."""
