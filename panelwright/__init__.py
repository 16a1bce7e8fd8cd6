"""Spark-first engine for building and analysing panels from messy sources."""
