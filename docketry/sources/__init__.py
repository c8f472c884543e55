"""Readers and writers, and the parsers that turn files into documents."""
