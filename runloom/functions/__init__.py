"""Scalar expressions: sizes, keys, hashes, validation."""
