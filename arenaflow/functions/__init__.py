"""Reusable column expressions and DataFrame kernels."""
