"""Relational, window and statistical operators over DataFrames."""
