"""Scalar expressions and numeric kernels."""
