"""Hybrid document retrieval and corpus preparation, expressed as Spark DataFrames."""
