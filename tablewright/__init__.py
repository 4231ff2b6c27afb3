"""Data preparation and data quality on Spark.

Every operator takes and returns DataFrames; see README.md for the map from
capability to function.
"""
