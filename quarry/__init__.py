"""Spark jobs for profiling, cleaning, mining and learning over DataFrames."""
