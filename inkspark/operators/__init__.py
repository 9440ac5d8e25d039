"""Logical operators over glyph and line tables."""
