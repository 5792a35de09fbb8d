"""Operators over DataFrames of files, members, sections and records."""
