"""Geometry columns from plain ones. Tables are read by Spark's own readers."""
