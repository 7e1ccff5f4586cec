"""Catalog, interaction and recommendation operators on Spark DataFrames."""
