"""featlake: geospatial feature collections as Spark DataFrames."""

from featlake.table import FeatureTable

__all__ = ["FeatureTable"]
