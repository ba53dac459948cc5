"""Readers and writers of the wire formats and traces."""
