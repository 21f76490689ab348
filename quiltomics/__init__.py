"""Spatial multi-omics catalogue, split and benchmark operators on Spark DataFrames."""

__version__ = "0.1.0"
