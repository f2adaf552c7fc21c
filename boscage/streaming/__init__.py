"""Scans that arrive as streams."""
