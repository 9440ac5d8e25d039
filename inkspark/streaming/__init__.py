"""Extraction over streams of files."""
