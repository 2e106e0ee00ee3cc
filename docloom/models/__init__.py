"""Pluggable model steps."""
