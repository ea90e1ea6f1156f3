"""Readers and writers for the file formats of the domain."""
