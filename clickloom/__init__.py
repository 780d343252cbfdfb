"""Click-log feature preparation and word-vector lookup on Spark DataFrames."""

from clickloom.spec import FeatureSpec

__all__ = ["FeatureSpec"]
