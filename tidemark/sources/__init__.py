"""Readers that bring raw files into typed DataFrames."""
