"""Scalar functions: strings, codecs, vector arithmetic."""
