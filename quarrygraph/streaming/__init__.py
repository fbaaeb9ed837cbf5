"""Streaming re-lift of changed source files."""
