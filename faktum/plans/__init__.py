"""Whole extractions, put together from functions, operators and sources."""
