"""Readers that make files and their parts into rows."""
