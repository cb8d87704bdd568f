"""Whole plans: build, tools, text projection, statistics."""
