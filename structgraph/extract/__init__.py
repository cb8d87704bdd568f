"""Extractors of framework facts from source text, as column expressions."""
