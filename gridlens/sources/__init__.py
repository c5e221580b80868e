"""Readers and parsers of incoming data."""
