"""Spatial-layer analytics expressed as Spark DataFrame plans."""
