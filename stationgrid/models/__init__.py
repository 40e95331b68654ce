"""Trend, tree and kriging stages and the bagged ensemble."""
