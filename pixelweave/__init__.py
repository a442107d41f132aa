"""Raster and feature-map analytics as Spark DataFrame operators."""
