"""Scalar functions, as Python at plan time and as Column expressions."""
