"""Ensemble data-assimilation analytics on Spark DataFrames."""
