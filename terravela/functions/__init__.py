"""Scalar functions as Column expressions: geodesy, geometry, encodings, text."""
