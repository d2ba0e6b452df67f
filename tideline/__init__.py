"""tideline: exact and progressive (online-aggregation) analytics on Spark DataFrames."""

__version__ = "0.1.0"
