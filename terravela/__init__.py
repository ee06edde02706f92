"""Terrain-survey and catalogue analytics on PySpark DataFrames."""
