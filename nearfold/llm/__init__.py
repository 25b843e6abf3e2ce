"""Operators of a training-data pipeline, each one a Spark job over whole tables."""
