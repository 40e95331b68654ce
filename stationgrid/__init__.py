"""Spark-native analysis of scattered station temperatures into gridded fields."""

from stationgrid.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
