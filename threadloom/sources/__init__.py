"""Readers, writers and the thread store."""
