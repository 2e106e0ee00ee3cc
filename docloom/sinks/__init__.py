"""Sinks: decision records and reports."""
