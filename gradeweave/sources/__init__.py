"""Reads and writes."""
