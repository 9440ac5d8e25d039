"""Extraction as one logical plan."""
