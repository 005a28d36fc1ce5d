"""Readers and writers for landed metadata."""
