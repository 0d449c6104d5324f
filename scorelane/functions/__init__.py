"""Scalar expressions: clamping, half precision, distances, and timestamps."""
