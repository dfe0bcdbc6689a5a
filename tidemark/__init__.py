"""Observation-series analytics on Spark: table operators, plans and streaming twins."""
