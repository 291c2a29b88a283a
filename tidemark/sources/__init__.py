"""Readers, writers and the declared schemas of every layer."""
