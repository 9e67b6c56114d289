"""Symbols of source files, by language."""
