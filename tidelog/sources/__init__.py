"""Readers: files, tables and exports into DataFrames with known columns."""
