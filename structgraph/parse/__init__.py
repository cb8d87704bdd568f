"""Parsers: source text to facts, one row per fact."""
