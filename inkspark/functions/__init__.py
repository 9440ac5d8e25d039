"""Scalar functions: codecs, encodings, geometry."""
