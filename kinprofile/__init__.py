"""Grouped profile clustering of coded tabular records on Spark."""

from kinprofile.spec import FeatureSpec, Nominal, Ordinal

__all__ = ["FeatureSpec", "Nominal", "Ordinal"]
