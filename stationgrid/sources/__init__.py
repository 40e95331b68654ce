"""Readers and parsers for station feeds, rasters, boundaries and lookup tables."""
