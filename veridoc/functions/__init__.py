"""Scalar functions as SQL text: literals, regular expressions, formats, JSON values."""
