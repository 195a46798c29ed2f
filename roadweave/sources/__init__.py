"""Readers, writers and the keyed result store."""
